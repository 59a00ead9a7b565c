"""Documents arriving as a stream: each content once, replays harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from docweft.functions import text as T
from docweft.operators.dense import Encoder
from docweft.operators.index import ChunkIndex


def distinct_contents(docs: DataFrame, text: str = "text") -> DataFrame:
    """A stream (or table) of documents with ``sha256``, the first of each content.

    On a stream the hashes seen are state; ``within`` watermarks are not used, since a copy may arrive at any time.
    """
    return docs.where(F.col(text).isNotNull()).withColumn("sha256", T.fingerprint(F.encode(F.col(text), "UTF-8"))).dropDuplicates(["sha256"])


def read_documents(spark: SparkSession, folder: str, schema: t.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest_stream(docs: DataFrame, root: str, checkpoint: str, encoder: Encoder | None = None, on_batch=None):
    """Append a stream of extracted documents (``sha256, filename, pages, chunks``) to an index, as far as there is input.

    A batch that is replayed after a failure finds its documents there already, so each is appended once.
    ``on_batch(batch_id, committed)`` reports progress.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        committed = ChunkIndex.open(batch.sparkSession, root).append(batch, encoder)
        if on_batch:
            on_batch(batch_id, committed)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """Events per window and type with a watermark; an extension, for streams with event time."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(ts, late)
    return e.groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
