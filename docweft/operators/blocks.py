"""Best lists of a set of queries against all documents, block by block.

Documents and queries are cut into blocks by hashes of their ids.  A task gets one block of each, scores their
pairs as arrays and gives each query its best documents there, so pairs are never rows.  The blocks' sizes
bound what a task holds; their numbers follow from the data by expressions, so nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.session import ships

#: Queries in a block.
QUERY_BLOCK = 1 << 16


def paired(docs: DataFrame, queries: DataFrame, doc: str, query: str, sizes: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on every pair of a block of ``docs`` and a block of ``queries``; ``sizes`` is one row with the numbers of blocks ``__db`` and ``__qb``."""
    one = F.broadcast(sizes.select(F.greatest(F.lit(1), "__db").cast("int").alias("__db"), F.greatest(F.lit(1), "__qb").cast("int").alias("__qb")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = docs.crossJoin(one).withColumn("__b", F.pmod(F.xxhash64(doc), F.col("__db")).cast("int")).withColumn("__q", every("__qb")).drop("__db", "__qb")
    q = queries.crossJoin(one).withColumn("__q", F.pmod(F.xxhash64(query), F.col("__qb")).cast("int")).withColumn("__b", every("__db")).drop("__db", "__qb")
    return d.groupBy("__b", "__q").cogroup(q.groupBy("__b", "__q")).applyInArrow(run, schema)


def ids_in_order(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids of a column, ascending, and each row's place among them."""
    import pyarrow.compute as pc

    enc = column.combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(enc.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return enc.dictionary.take(order), place[enc.indices.to_numpy()]


def best(scores: np.ndarray, depth: int) -> np.ndarray:
    """Places of the ``depth`` largest scores, equal ones in order of place; not-a-number scores are none."""
    if len(scores) > depth:
        low = -np.partition(-scores, depth - 1)[depth - 1]
        at = np.flatnonzero(scores >= low) if low == low else np.flatnonzero(scores == scores)
    else:
        at = np.flatnonzero(scores == scores)
    return at[np.argsort(-scores[at], kind="stable")][:depth]


def ranked(lists: DataFrame, depth: int, query: str, doc: str, score: str, rank: str) -> DataFrame:
    """The best ``depth`` of each query from its blocks' lists, ties by document id."""
    w = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(doc))
    return lists.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= depth)


ships(__name__)
