"""Reciprocal rank fusion, hybrid search and reranking, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.operators import dense, lexical

RRF_K = 60.0
CANDIDATE_DEPTH = 50
CONSIDERED = 5


def rrf(rankings: DataFrame, query: str = "query_id", doc: str = "chunk_pos", source: str = "source", rank: str = "rank", weights: dict[str, float] | None = None, k: float = RRF_K) -> DataFrame:
    """``query, doc, rrf_score, place`` from any number of ranked lists in long form.

    A list adds ``weight / (k + rank)``; a document that is not in it gets nothing from it.  Ties go to the
    better place in the first list by name, then the next.  A weight for a list that
    is missing, or a list without a weight where weights are given, is an error at run time.
    """
    w = F.lit(1.0)
    if weights is not None:
        w = F.create_map(*[x for n, v in weights.items() for x in (F.lit(n), F.lit(float(v)))])[F.col(source)]
        w = F.coalesce(w, F.raise_error(F.concat(F.lit("no weight for "), F.col(source))).cast("double"))
    summed = rankings.groupBy(query, doc).agg(F.sum(w / (F.lit(k) + F.col(rank))).alias("rrf_score"), F.array_sort(F.collect_list(F.struct(source, rank))).alias("__seen"))
    order = W.partitionBy(query).orderBy(F.col("rrf_score").desc(), "__seen")
    return summed.withColumn("place", F.row_number().over(order)).drop("__seen")


def fuse_two(first: DataFrame, second: DataFrame, query: str = "query_id", doc: str = "chunk_pos", a: str = "bm25_rank", b: str = "dense_place", weights: tuple[float, float] = (1.0, 1.0), k: float = RRF_K) -> DataFrame:
    """Full outer join of two rankings with both ranks kept; equal scores in the order of the first list, then the second."""
    both = first.select(query, doc, a).join(second.select(query, doc, b), [query, doc], "full_outer")
    score = sum((F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(c)), F.lit(0.0)) for w, c in zip(weights, (a, b))), F.lit(0.0))
    order = W.partitionBy(query).orderBy(F.col("rrf_score").desc(), F.col(a).asc_nulls_last(), F.col(b).asc_nulls_last())
    return both.withColumn("rrf_score", score).withColumn("place", F.row_number().over(order))


def hybrid_search(queries: DataFrame, index: lexical.LexicalIndex, vectors: DataFrame, chunks: DataFrame, k: int = 5, considered: int = CONSIDERED, depth: int = CANDIDATE_DEPTH,
                  weights: tuple[float, float] = (1.0, 1.0), query: str = "query_id", doc: str = "chunk_pos", question: str = "question", exclude: str | None = None) -> DataFrame:
    """Hits and the next ``considered`` of every query, with both ranks; ``slot`` tells them apart.

    ``queries`` has ``query, question, qvec``; a query without a vector, like a document without one, is ranked by
    its words alone.  ``exclude`` names a query column with an id that is no candidate of that query and takes no
    place in a list.  Texts and other columns of ``chunks`` are joined last, to the few rows that are left.
    """
    own = queries.select(query, F.col(exclude).alias("own")) if exclude else None
    words = lexical.ranking(index, lexical.query_terms(queries, query, question), depth, doc, query, own=own)
    near = dense.block_ranking(queries, vectors, depth, query, doc, exclude=exclude)
    fused = fuse_two(words, near, query, doc, weights=weights).where(F.col("place") <= k + considered)
    slot = F.when(F.col("place") <= k, F.lit("hit")).otherwise(F.lit("considered"))
    return fused.withColumn("slot", slot).join(chunks, doc)


def lexical_only(ranked: DataFrame, k: int, rank: str = "bm25_rank", rrf_k: float = RRF_K) -> DataFrame:
    """Search without an encoder: the lexical order with the score ``1 / (k + rank)``; weights have no effect, and there may be fewer than ``k``."""
    return ranked.where(F.col(rank) <= k).withColumn("rrf_score", F.lit(1.0) / (F.lit(rrf_k) + F.col(rank)))


def rerank(ranked: DataFrame, head: int, score: Column, query: str = "query_id", rank: str = "place", out: str = "reranked") -> DataFrame:
    """The best ``head`` in the order of ``score``, ties as before; the tail follows unchanged."""
    top = F.col(rank) <= head
    order = W.partitionBy(query).orderBy((~top).cast("int"), F.when(top, score).desc_nulls_last(), F.col(rank))
    return ranked.withColumn(out, F.row_number().over(order))
