"""A persistent, append-only chunk index: Parquet batches and a manifest that is written last.

Each append writes its documents under ``batch=<id>`` of the tables and then creates the next manifest,
which lists the batches that count with their numbers of rows.  Readers follow the newest whole manifest, so a batch whose
manifest was never written is invisible.  A manifest is created only if its number is new: of two writers
one fails and can try again.  Every batch has its own document frequencies and lengths, which are added up when read, so an
append rewrites nothing; ``compact`` merges batches.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.vectors import norm
from docweft.operators import dense, fusion, lexical
from docweft.operators.gates import GateError, require_empty

SCHEMA_VERSION = 2
TABLES = ("chunks", "documents", "postings", "terms", "embeddings")
#: Tables that can be made again from the chunks.
DERIVED = ("documents", "postings", "terms")
HITS = "query_id string, chunk_id string, bm25_rank int, dense_place int, rrf_score double, place int, slot string, doc_sha256 string, filename string, page int, char_start bigint, char_end bigint, text string, n_tokens int"


class ConflictError(RuntimeError):
    """Another writer committed first."""


@dataclass
class Manifest:
    version: int = 0
    schema_version: int = SCHEMA_VERSION
    embedder_id: str | None = None
    tokenizer_sha256: str | None = None
    batches: list[str] = field(default_factory=list)
    #: Rows of each table by batch, and the tokens of its chunks under ``tokens``.
    rows: dict[str, dict[str, int]] = field(default_factory=dict)


class Storage:
    """The few file operations the manifest needs, through Hadoop's file system, so any shared folder will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.root)] if self.fs.exists(self.root) else []

    def read(self, name: str) -> str:
        s = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def create(self, name: str, text: str) -> None:
        """Create a file; fails if it exists, in one step where the file system can do that."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            raise ConflictError(name) from e
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.fs.exists(self.path(name)) else 0


class ChunkIndex:
    """``open``, ``has_document``, ``append``, ``search``, ``stats``, ``vacuum``."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest):
        self.spark, self.root, self.manifest = spark, root, manifest
        self.storage = Storage(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> ChunkIndex:
        s = Storage(spark, root)
        s.fs.mkdirs(s.root)
        m = Manifest()
        for name in sorted((n for n in s.names() if n.startswith("manifest-")), reverse=True):
            try:
                m = Manifest(**json.loads(s.read(name)))
                break
            except json.JSONDecodeError:
                continue  # its writer was stopped halfway: not committed
        if m.schema_version != SCHEMA_VERSION:
            raise GateError(f"index schema {m.schema_version}, expected {SCHEMA_VERSION}")
        index = cls(spark, root, m)
        index._check_complete()
        return index

    def _check_complete(self) -> None:
        """Every committed batch has its rows.  Lost chunks or vectors are fatal; what is derived from chunks is made again."""
        for t in TABLES:
            want = {b: self.manifest.rows[b][t] for b in self.manifest.batches if t in self.manifest.rows[b]}
            there = set(Storage(self.spark, f"{self.root}/{t}").names())
            short = [b for b in want if f"batch={b}" not in there]
            if not short and want and self._read(t, list(want)).count() != sum(want.values()):
                short = [b for b in want if self._read(t, [b]).count() != want[b]]
            if short and t not in DERIVED:
                raise GateError(f"{t}: committed batches miss rows: {short[:3]}")
            for b in short:
                self._derive(t, b)

    def _read(self, table: str, batches: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/batch={b}" for b in batches]).drop("batch")

    def _write(self, df: DataFrame, table: str, batch: str, mode: str = "error") -> dict[str, int]:
        """Write one table of a batch; its number of rows, and the tokens of postings, are counted on the way."""
        seen = Observation()
        counts = [F.count(F.lit(1)).alias(table), *([F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")] if table == "postings" else [])]
        df.observe(seen, *counts).write.mode(mode).parquet(f"{self.root}/{table}/batch={batch}")
        return seen.get

    def _derive(self, table: str, batch: str) -> dict[str, int]:
        chunks = self._read("chunks", [batch])
        if table == "postings":
            df = lexical.postings(chunks, "chunk_id")
        elif table == "terms":
            df = self._read("postings", [batch]).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        else:
            df = chunks.groupBy("doc_sha256").agg(F.first("filename", True).alias("filename"), F.count(F.lit(1)).alias("n_chunks"))
        return self._write(df, table, batch, "overwrite")

    @property
    def empty(self) -> bool:
        return not self.manifest.batches

    def table(self, name: str) -> DataFrame:
        if self.empty:
            raise GateError("the index is empty")
        return self._read(name, self.manifest.batches)

    def documents(self) -> DataFrame:
        return self.table("documents")

    def has_document(self, sha256: str) -> bool:
        return not self.empty and bool(self.documents().where(F.col("doc_sha256") == sha256).take(1))

    def check_encoder(self, encoder: dense.Encoder | None) -> None:
        """Fatal if the index was made with another model or tokenizer."""
        m = self.manifest
        if encoder and m.embedder_id is not None and (encoder.model_id, encoder.tokenizer_sha256) != (m.embedder_id, m.tokenizer_sha256):
            raise GateError(f"encoder {encoder.model_id}, the index has {m.embedder_id}")
        if encoder and not self.empty and m.embedder_id is None:
            raise GateError("the index has no vectors")

    def append(self, docs: DataFrame, encoder: dense.Encoder | None = None, before_commit=None) -> int:
        """Add documents (``sha256, filename, pages, chunks``) that are not there yet; returns how many batches were committed, 0 or 1.

        Repeated rows of one hash count once.  ``before_commit`` is called between the tables and the
        manifest, for tests of what a crash there leaves behind.
        """
        self.check_encoder(encoder)
        if encoder is None and self.manifest.embedder_id is not None:
            raise GateError(f"the index has vectors of {self.manifest.embedder_id}; an append without them would leave chunks out")
        rows = docs.where("sha256 is not null").groupBy("sha256").agg(F.max(F.struct(F.size("chunks").alias("n"), "filename", "chunks")).alias("d")).select("sha256", "d.filename", "d.chunks")
        if not self.empty:
            rows = rows.join(self.documents().select(F.col("doc_sha256").alias("sha256")), "sha256", "left_anti")
        c = rows.select("sha256", "filename", F.posexplode("chunks").alias("ordinal", "c"))
        chunks = c.select(T.chunk_id(F.col("sha256"), F.col("ordinal")).alias("chunk_id"), F.col("sha256").alias("doc_sha256"), "filename", "c.page", "c.char_start", "c.char_end", "c.text", "c.n_tokens")
        batch = uuid.uuid4().hex
        n = self._write(chunks, "chunks", batch)
        if not n["chunks"]:
            self.storage.delete(f"chunks/batch={batch}")
            return 0
        for t in DERIVED:
            n |= self._derive(t, batch)
        new = self._read("documents", [batch]).select("doc_sha256")
        seen = new if self.empty else self.documents().select("doc_sha256").unionByName(new)
        require_empty(seen.groupBy(F.substring("doc_sha256", 1, 8).alias("start")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "two documents share the first eight digits of their hash")
        if encoder:
            n |= self._write(dense.encode(self._read("chunks", [batch]), encoder, "chunk_id", "text"), "embeddings", batch)
            vecs = self._read("embeddings", [batch])
            require_empty(vecs.where((F.abs(norm(F.col("vec")) - 1) > 1e-5) & (norm(F.col("vec")) > 0)), "vectors off unit length")
        if before_commit:
            before_commit()
        self._commit([*self.manifest.batches, batch], self.manifest.rows | {batch: n}, encoder)
        return 1

    def _commit(self, batches: list[str], rows: dict, encoder: dense.Encoder | None = None) -> None:
        m = self.manifest
        new = Manifest(m.version + 1, SCHEMA_VERSION, encoder.model_id if encoder else m.embedder_id, encoder.tokenizer_sha256 if encoder else m.tokenizer_sha256, batches, {b: rows[b] for b in batches})
        self.storage.create(f"manifest-{new.version:012d}.json", json.dumps(new.__dict__))
        self.manifest = new

    def compact(self) -> None:
        """Merge all batches into one, as a new version; ``vacuum`` then removes the old ones."""
        if len(self.manifest.batches) < 2:
            return
        batch = uuid.uuid4().hex
        n: dict[str, int] = {}
        for t in ("chunks", "embeddings") if self.manifest.embedder_id is not None else ("chunks",):
            n |= self._write(self.table(t), t, batch)
        for t in DERIVED:
            n |= self._derive(t, batch)
        self._commit([batch], {batch: n})

    def vacuum(self) -> list[str]:
        """Delete batches that no manifest lists; only when no writer is at work."""
        gone = []
        for t in TABLES:
            for n in Storage(self.spark, f"{self.root}/{t}").names():
                if n.startswith("batch=") and n[6:] not in self.manifest.batches:
                    self.storage.delete(f"{t}/{n}")
                    gone.append(f"{t}/{n}")
        return gone

    def lexical_index(self) -> lexical.LexicalIndex:
        """Postings as stored, and the batches' frequencies and lengths added up, so they are right whatever was appended."""
        rows = [self.manifest.rows[b] for b in self.manifest.batches]
        n, tokens = sum(r["chunks"] for r in rows), sum(r["tokens"] for r in rows)
        corpus = self.spark.range(1).select(F.lit(n).alias("n"), F.lit(tokens / n).alias("avgdl"))
        idf = F.greatest(F.lit(lexical.IDF_FLOOR), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
        return lexical.LexicalIndex(self.table("postings"), self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).select("term", "df", idf.alias("idf")), corpus)

    def search(self, queries: DataFrame, k: int = 5, encoder: dense.Encoder | None = None, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
        """Hits and considered chunks of a batch of ``query_id, question``; lexical only without an encoder; no rows from an empty index."""
        self.check_encoder(encoder)
        if self.empty:
            return self.spark.createDataFrame([], HITS)
        index, chunks = self.lexical_index(), self.table("chunks")
        if encoder is None:
            ranked = lexical.ranking(index, lexical.query_terms(queries), fusion.CANDIDATE_DEPTH, "chunk_id")
            out = fusion.lexical_only(ranked, k + fusion.CONSIDERED).withColumn("place", F.col("bm25_rank"))
            return out.withColumn("slot", F.when(F.col("place") <= k, F.lit("hit")).otherwise(F.lit("considered"))).withColumn("dense_place", F.lit(None).cast("int")).join(chunks, "chunk_id")
        q = queries.join(dense.encode(queries, encoder, "query_id", "question", True).withColumnRenamed("vec", "qvec"), "query_id")
        return fusion.hybrid_search(q, index, self.table("embeddings"), chunks, k, weights=weights, doc="chunk_id")

    def timings(self, queries: DataFrame, k: int = 5, encoder: dense.Encoder | None = None) -> dict[str, float]:
        """Seconds of the lexical leg, the dense leg and the whole search of a batch of questions, each run by itself."""
        out: dict[str, float] = {}

        def run(name: str, df: DataFrame) -> None:
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            out[name] = time.perf_counter() - began

        if not self.empty:
            run("bm25", lexical.ranking(self.lexical_index(), lexical.query_terms(queries), fusion.CANDIDATE_DEPTH, "chunk_id"))
            if encoder:
                q = dense.encode(queries, encoder, "query_id", "question", True).withColumnRenamed("vec", "qvec")
                run("dense", dense.block_ranking(q, self.table("embeddings"), fusion.CANDIDATE_DEPTH, doc="chunk_id"))
        run("total", self.search(queries, k, encoder))
        return out

    def stats(self) -> dict:
        size = {f"{t}_bytes": sum(self.storage.size(f"{t}/batch={b}") for b in self.manifest.batches) for t in TABLES}
        rows = [self.manifest.rows[b] for b in self.manifest.batches]
        return {"n_documents": sum(r["documents"] for r in rows), "n_chunks": sum(r["chunks"] for r in rows), "version": self.manifest.version, **size}
