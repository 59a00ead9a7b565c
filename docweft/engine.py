"""The engine behind the command line: ingest documents, answer questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import chunking, dense, grading
from docweft.operators.index import ChunkIndex
from docweft.sources import files
from docweft.sources.models import Client, EchoClient, complete_all


class EmptyIndex(RuntimeError):
    """There is nothing to search yet."""


@dataclass
class IngestSummary:
    n_files: int = 0
    n_newly_indexed: int = 0
    stats: dict = field(default_factory=dict)


@dataclass
class Engine:
    spark: SparkSession
    root: str
    encoder: dense.Encoder | None = field(default_factory=dense.HashingEncoder)
    make_client: Callable[[], Client] = EchoClient
    parser: Callable = files.plain_parser
    suffix: str = ".txt"
    budget: int = chunking.BUDGET

    def extracted(self, paths: list[str]) -> DataFrame:
        """``sha256, filename, pages, chunks`` of files."""
        found = files.read_binary(self.spark, files.expand_paths(paths, self.suffix))
        name = F.element_at(F.split("path", "/"), -1)
        base = found.select("sha256", name.alias("filename"), "path", "content").dropDuplicates(["sha256"])
        lines = files.extract_lines(base, self.parser).join(base.select("path", "sha256"), "path").withColumn("doc", F.col("sha256"))
        streams = chunking.document_stream(lines, "doc").join(base.select(F.col("sha256").alias("doc"), "filename"), "doc")
        title = F.regexp_replace(F.regexp_replace("filename", r"\.[^.]*$", ""), "_", " ")
        packed = chunking.pack_sentences(chunking.sections(streams, "doc", title=title), budget=self.budget)
        rows = packed.select("doc", "seg_no", "seg_start", F.posexplode("chunks").alias("in_seg", "text"))
        placed = chunking.body_offsets(rows, streams, "doc")
        starts = chunking.line_offsets(lines, "doc")
        pages = chunking.page_of_offset(placed.select("doc", F.col("seg_start").cast("long").alias("at")).distinct(), starts, "doc", "at")
        placed = placed.withColumn("at", F.col("seg_start").cast("long")).join(pages, ["doc", "at"], "left")
        chunk = F.struct(F.coalesce("page", F.lit(1)).cast("int").alias("page"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text", T.token_estimate(F.col("text")).alias("n_tokens"))
        docs = placed.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "in_seg", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"), F.max("page").alias("pages"))
        return docs.join(base.select(F.col("sha256").alias("doc"), "filename"), "doc").select(F.col("doc").alias("sha256"), "filename", "pages", "chunks")

    def ingest(self, docs: DataFrame) -> int:
        return ChunkIndex.open(self.spark, self.root).append(docs, self.encoder)

    def ingest_paths(self, paths: list[str], on_event: Callable[[str], None] | None = None) -> IngestSummary:
        """Known contents are left out before anything is extracted."""
        index = ChunkIndex.open(self.spark, self.root)
        before = index.stats()["n_documents"]
        n = len(files.expand_paths(paths, self.suffix))
        if on_event:
            on_event(f"{n} files")
        index.append(self.extracted(paths), self.encoder)
        stats = index.stats()
        return IngestSummary(n, stats["n_documents"] - before, stats)

    def search(self, questions: DataFrame, k: int = 5) -> DataFrame:
        index = ChunkIndex.open(self.spark, self.root)
        if index.empty:
            raise EmptyIndex("ingest documents first")
        return index.search(questions, k, self.encoder)

    def answers(self, questions: DataFrame, k: int = 3) -> DataFrame:
        """``query_id, answer, abstained, sources, near_misses, seconds, tokens_per_second`` of a batch of ``query_id, question``.

        An answer names its sources; one that abstains names the passages that came nearest instead, hits first."""
        found = self.search(questions, k)
        hits = found.where("slot = 'hit'")
        context = grading.contexts(hits.withColumn("rank", F.col("place")))
        system, user = grading.PROMPTS["grounded"]
        prompts = questions.join(context, "query_id", "left").select("query_id", F.lit(system).alias("system"), grading.fill(user, context=F.col("context"), question=F.col("question")).alias("user"))
        said = complete_all(prompts, self.make_client, "query_id")
        where = F.concat("filename", F.lit(" p"), F.coalesce(F.col("page").cast("string"), F.lit("?")))
        near = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", where.alias("w"), "slot"))), lambda s: F.struct(s["w"], s["slot"])))
        places = found.groupBy("query_id").agg(near.alias("near"))
        abstained = grading.abstained_prefix(F.col("reply"))
        named = lambda keep: F.array_distinct(F.transform(F.filter("near", keep), lambda s: s["w"]))
        return said.join(places, "query_id", "left").select(
            "query_id", F.col("reply").alias("answer"), abstained.alias("abstained"), F.when(~abstained, named(lambda s: s["slot"] == "hit")).alias("sources"),
            F.when(abstained, named(lambda s: F.lit(True))).alias("near_misses"), "seconds", grading.tokens_per_second(F.col("n_tokens"), F.col("ns")).alias("tokens_per_second"))

    def judged(self, answers: DataFrame, make_client: Callable[[], Client], key: str = "answer_id") -> DataFrame:
        return grading.judge(answers, make_client, key)
