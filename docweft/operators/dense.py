"""Dense ranking by cosine, encoders behind a small interface."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.functions.vectors import dot, norm
from docweft.operators import blocks
from docweft.session import ships

# Instruction prefixes that models were trained with, query then passage.
PREFIXES = {
    "intfloat/e5": ("query: ", "passage: "),
    "BAAI/bge": ("Represent this sentence for searching relevant passages: ", ""),
}
#: Numbers of the vectors in a block, so documents in a block times dimensions, and queries in one block.
NUMBER_BLOCK, QUERY_BLOCK = 1 << 24, 1 << 13
#: Queries multiplied at a time.
STEP = 256


class Encoder(Protocol):
    """Turns texts into unit vectors.  ``model_id`` and ``tokenizer_sha256`` name what an index was made with."""

    model_id: str
    tokenizer_sha256: str
    dim: int

    def encode(self, texts: list[str], is_query: bool) -> np.ndarray: ...


def prefix_for(model: str) -> tuple[str, str]:
    return next((p for k, p in PREFIXES.items() if model.startswith(k)), ("", ""))


@dataclass
class HashingEncoder:
    """A deterministic stand-in: signed hashed word counts at unit length.  Needs no model file."""

    dim: int = 64
    model_id: str = "hashing"
    tokenizer_sha256: str = ""

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h & (1 << 30) else -1
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


@dataclass
class OnnxEncoder:
    """First-token pooling of an ONNX model; the session is opened once per worker.  Files are parameters."""

    onnx_path: str
    tokenizer_path: str
    model_id: str
    tokenizer_sha256: str = ""
    dim: int = 384
    max_length: int = 512
    _loaded: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": {}}

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        if not self._loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.tokenizer_path)
            tok.enable_padding()
            tok.enable_truncation(self.max_length)
            self._loaded |= {"tok": tok, "run": onnxruntime.InferenceSession(self.onnx_path, providers=["CPUExecutionProvider"])}
        prefix = prefix_for(self.model_id)[0 if is_query else 1]
        enc = self._loaded["tok"].encode_batch([prefix + (t or "") for t in texts])
        run = self._loaded["run"]
        feed = {"input_ids": [e.ids for e in enc], "attention_mask": [e.attention_mask for e in enc], "token_type_ids": [e.type_ids for e in enc]}
        out = run.run(None, {i.name: np.array(feed[i.name], dtype=np.int64) for i in run.get_inputs()})[0][:, 0]
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def encode(df: DataFrame, encoder: Encoder, key: str, text: str, is_query: bool = False, batch: int = 64) -> DataFrame:
    """``key, vec``: the vectors of a text column, made in batches on the executors.  Null texts count as empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(texts), batch):
                v = np.asarray(encoder.encode(texts[i : i + batch], is_query), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, batch), pa.array(list(v), pa.list_(pa.float32()))], names=[key, "vec"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, vec array<float>")


def ranking(queries: DataFrame, vectors: DataFrame, depth: int, query: str = "query_id", doc: str = "chunk_pos", qvec: str = "qvec", vec: str = "vec",
            exclude: str | None = None, rank: str = "dense_place") -> DataFrame:
    """The ``depth`` vectors nearest to each query by cosine at six places, ties by id; one expression per pair.

    For small query sets inside a larger plan; ``block_ranking`` does the same by matrix products and is
    what search uses.  ``exclude`` names a query column with an id that is no candidate of that query.
    """
    pairs = vectors.select(doc, vec).join(queries.select(query, qvec, *([exclude] if exclude else [])), how="cross")
    if exclude:
        pairs = pairs.where(F.col(exclude).isNull() | (F.col(exclude) != F.col(doc)))
    scored = pairs.select(query, doc, F.round(dot(F.col(qvec), F.col(vec)), 6).alias("sim"))
    w = W.partitionBy(query).orderBy(F.col("sim").desc(), F.col(doc))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= depth)


def block_ranking(queries: DataFrame, vectors: DataFrame, depth: int, query: str = "query_id", doc: str = "chunk_pos", qvec: str = "qvec", vec: str = "vec",
                  exclude: str | None = None, rank: str = "dense_place", number_block: int = NUMBER_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``ranking`` by matrix products of a block of vectors and a block of queries, of which only each query's best list goes on.

    Null vectors on either side are left out.
    """
    kinds = {c: (queries.schema[c] if c == query else vectors.schema[c]).dataType.simpleString() for c in (query, doc)}
    d = vectors.where(F.col(vec).isNotNull()).select(doc, vec)
    q = queries.where(F.col(qvec).isNotNull()).select(query, qvec, (F.col(exclude) if exclude else F.lit(None)).cast(kinds[doc]).alias("__own"))
    sizes = d.agg(F.ceil(F.sum(F.size(vec)) / F.lit(number_block)).alias("__db")).crossJoin(F.broadcast(q.agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).alias("__qb"))))
    sizes = sizes.select(F.coalesce("__db", F.lit(1)).alias("__db"), "__qb")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [query, doc, "sim"]
        if not left.num_rows or not right.num_rows:
            return pa.table([right.column(query).slice(0, 0), left.column(doc).slice(0, 0), pa.array([], pa.float64())], names=names)
        ids, at = blocks.ids_in_order(left.column(doc))
        rows = matrix(left.column(vec))
        v = np.zeros((len(ids), rows.shape[1]))
        v[at] = rows
        asked, own = matrix(right.column(qvec)), right.column("__own").to_pylist()
        place = {x: i for i, x in enumerate(ids.to_pylist())} if any(x is not None for x in own) else {}
        qs, ds, sims = [], [], []
        for k in range(0, len(asked), STEP):
            sim = np.round(asked[k : k + STEP] @ v.T, 6)
            for n, row in enumerate(sim, k):
                if own[n] in place:
                    row[place[own[n]]] = np.nan
                top = blocks.best(row, depth)
                qs.append(np.full(len(top), n))
                ds.append(top)
                sims.append(row[top])
        return pa.table([right.column(query).take(pa.array(np.concatenate(qs))), ids.take(pa.array(np.concatenate(ds))), pa.array(np.concatenate(sims))], names=names)

    lists = blocks.paired(d, q, doc, query, sizes, run, f"`{query}` {kinds[query]}, `{doc}` {kinds[doc]}, sim double")
    return blocks.ranked(lists, depth, query, doc, "sim", rank)


def unit_norm_gate(vectors: DataFrame, vec: str = "vec", tolerance: float = 1e-5) -> DataFrame:
    """One row: vectors, those off unit length by more than ``tolerance``, and whether the gate passes."""
    off = F.abs(norm(F.col(vec)) - 1) > F.lit(tolerance)
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.coalesce(F.sum(off.cast("long")), F.lit(0)).alias("n_off")).withColumn("passed", F.col("n_off") == 0)


ships(__name__)
