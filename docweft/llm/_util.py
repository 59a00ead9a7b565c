"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.session import ships  # noqa: F401 - used by the modules beside this one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_and_answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_table, rec_id, text`` of all chunks and all questions' answers; repeated rows are still in it."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("rec_table"), F.col("chunk_pos").cast("string").alias("rec_id"), "text")
    answers = table(spark, sf_dir, "questions_sme_v3").select(F.lit("questions_sme_v3").alias("rec_table"), F.col("id").alias("rec_id"), F.col("answer").alias("text"))
    return chunks.unionByName(answers)


def one_row_per_record(records: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per record.  Rows without an id are left out, since no result could name them; of
    different texts under one id the first in order counts, a null text only if there is no other."""
    present = records
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.min(text).alias(text))


def record_texts(rows: DataFrame, keys: list[str], text: str, wanted: Column, others: dict[str, Column] | None = None) -> DataFrame:
    """The texts that are ``wanted``, one row per record, with ``others`` aggregated over its repeated rows.

    Rows without an id are left out; of different texts under one id the one with the least 64-bit hash counts, wanted
    or not.  Only ids and hashes of all rows are shuffled, and the texts that are wanted.
    """
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.where(F.col(text).isNotNull()).withColumn("__h", F.xxhash64(text))
    own = rows.groupBy(*keys).agg(F.min("__h").alias("__h"))
    texts = rows.where(wanted).groupBy(*keys, "__h").agg(F.first(text).alias(text), *[c.alias(n) for n, c in (others or {}).items()])
    return texts.join(own, [*keys, "__h"], "left_semi").drop("__h")
