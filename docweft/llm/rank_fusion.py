"""One ranking from several scores: Borda count over competition ranks.

Each ranker orders its items by score; tied items share the mean of their places.  In a
query with ``m`` items an item earns ``m - place`` points from a ranker, times the ranker's
weight; where a ranker gave it no score, it gets the middle place ``(m + 1) / 2``.  Points are
added and sorted, equal sums by item.  Only places enter, so no ranker's range or outliers
can decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.operators.ranking import competition_ranks, row_ranks
from docweft.operators.skew import join_stats

QUERY, ITEM, RANKER, SCORE = "query_id", "chunk_id", "retriever", "score"
#: Queries with more rows than this, or than this part of all rows if that is more, are ranked in several tasks each.
#: So a task sorts at most so many rows of one query, and no more than ``1 / HOT_PART`` queries are listed as hot.
HOT_ROWS, HOT_PART = 1_000_000, 1e-5
#: Places that count as an item's best in a list.
TOP = 10


def scores_of(hits: DataFrame) -> DataFrame:
    """Rows with a score.  Null and not-a-number scores are none; rows without query, ranker or item are left out."""
    s = F.col(SCORE).cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & F.col(QUERY).isNotNull() & F.col(ITEM).isNotNull() & F.col(RANKER).isNotNull()
    return hits.where(ok).select(QUERY, RANKER, ITEM, s.alias(SCORE))


def _weight(weights: dict[str, float] | None):
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col(RANKER) == name, F.lit(float(value))).otherwise(w)
    return w


def _by_item(places: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """One row per query and item from rows with ``place``.  Rankers are told apart by hashes here, which aggregate without sorting."""
    place, who = F.col("place"), F.xxhash64(RANKER)
    return places.withColumn("__w", _weight(weights)).groupBy(QUERY, ITEM).agg(
        F.sum(F.col("__w") * place).alias("__wp"), F.sum("__w").alias("__has"), F.count(F.lit(1)).alias("n_scores"),
        F.sum((place <= TOP).cast("int")).alias("n_top"), F.sum((place == 1).cast("int")).alias("firsts"),
        F.max(F.when(place == 2, who)).alias("second_in"), F.max(F.when(place == 1, who)).alias("first_in"),
        F.sum("__head").alias("__heads"), F.sum(F.col("__head") * F.col("__w")).alias("__head_w"))


def _points(items: DataFrame) -> DataFrame:
    m = F.col("n_items")
    points = F.col("__all") * m - F.col("__wp") - (F.col("__all") - F.col("__has")) * (m + 1) / F.lit(2.0)
    return items.select(QUERY, ITEM, "n_scores", "n_rankers", "n_items", "n_top", "firsts", "second_in", "first_in", points.alias("points"))


def _usual(rows: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Items with points for queries that fit in a task: everything after one shuffle by query."""
    one = rows.repartition(QUERY).groupBy(QUERY, RANKER, ITEM).agg(F.max(SCORE).alias(SCORE)).withColumn("__down", -F.col(SCORE))
    by_rank, tied, query = W.partitionBy(QUERY, RANKER).orderBy("__down"), W.partitionBy(QUERY, RANKER, "__down"), W.partitionBy(QUERY)
    places = one.select(QUERY, RANKER, ITEM, "__down", F.rank().over(by_rank).alias("__r"), (F.row_number().over(by_rank) == 1).cast("int").alias("__head"))
    places = places.withColumn("place", F.col("__r") + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0))
    items = _by_item(places, weights)
    return _points(items.withColumns({"n_items": F.count(F.lit(1)).over(query), "n_rankers": F.sum("__heads").over(query), "__all": F.sum("__head_w").over(query)}))


def _hot(rows: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """The same for queries that no single task should hold: ranks by score buckets, salted joins."""
    one = rows.groupBy(QUERY, RANKER, ITEM).agg(F.max(SCORE).alias(SCORE))
    ranks = competition_ranks(one, [QUERY, RANKER], SCORE).select(QUERY, RANKER, SCORE, F.col("avg_rank").alias("place"))
    items = _by_item(one.join(ranks, [QUERY, RANKER, SCORE]).withColumn("__head", F.lit(0)), weights)
    lists = one.groupBy(QUERY, RANKER).agg(F.count(F.lit(1)).alias("n")).withColumn("__w", _weight(weights)).groupBy(QUERY).agg(F.sum("__w").alias("__all"), F.count(F.lit(1)).alias("n_rankers"))
    sizes = items.groupBy(QUERY).agg(F.count(F.lit(1)).alias("n_items")).join(lists, QUERY)
    return _points(join_stats(items, sizes, [QUERY], "n_items", [ITEM]))


def _split(hits: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the usual and of the hot queries.  The list of hot queries, at most ``1 / HOT_PART``, is broadcast."""
    rows = scores_of(hits)
    counts = rows.groupBy(QUERY).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.greatest(F.lit(hot_rows), F.sum("n") * F.lit(HOT_PART)).alias("most"))
    hot = F.broadcast(counts.crossJoin(F.broadcast(most)).where("n > most").select(QUERY))
    return rows.join(hot, QUERY, "left_anti"), rows.join(hot, QUERY, "left_semi")


def borda_points(hits: DataFrame, weights: dict[str, float] | None = None, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``query_id, chunk_id, n_scores, n_rankers, n_items, points`` and the item's best places, for the usual and the hot queries.

    Of several scores for one item from one ranker the largest counts.  ``weights`` defaults to 1 for every
    ranker; rankers it does not name have 1.  Rankers without a score in a query take no part in it.
    """
    usual, hot = _split(hits, hot_rows)
    return _usual(usual, weights), _hot(hot, weights)


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``query_id, chunk_id, n_scores, points, rank``: the combined list of every query, whole.

    ``chunk_id`` is a whole number.  Other columns are ignored; an empty table gives an empty result.
    """
    usual, hot = borda_points(hits, weights, hot_rows)
    first = usual.withColumn("rank", F.row_number().over(W.partitionBy(QUERY).orderBy(F.col("points").desc(), ITEM)).cast("long"))
    cols = [QUERY, ITEM, "n_scores", "points", "rank"]
    return first.select(*cols).unionByName(row_ranks(hot, [QUERY], "points", ITEM).select(*cols))


def outvoted_winners(hits: DataFrame, min_rankers: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``query_id, chunk_id``: leaders of the combined list that all rankers but one place first and that one
    second, behind an item that is in no other ranker's best ``TOP``.

    The leader comes from the Borda points, ties to the smaller id; its places then check the case.  With at least
    three rankers only one item can be first in all but one, and the item ahead of it is
    the only other one that is first anywhere.
    """

    def winners(items: DataFrame) -> DataFrame:
        outvoted = (F.col("firsts") == F.col("n_rankers") - 1) & F.col("second_in").isNotNull()
        alone = (F.col("firsts") == 1) & (F.col("n_top") == 1)
        best = F.struct("points", (-F.col(ITEM)).alias("i"))
        per = items.where(F.col("n_rankers") >= min_rankers).groupBy(QUERY).agg(
            F.max(best).alias("lead"), F.max(F.when(outvoted, best)).alias("win"), F.max(F.when(outvoted, F.col("second_in"))).alias("second_in"), F.max(F.when(alone, F.col("first_in"))).alias("ahead_in"))
        return per.where((F.col("lead") == F.col("win")) & (F.col("second_in") == F.col("ahead_in"))).select(QUERY, (-F.col("win.i")).alias(ITEM))

    usual, hot = borda_points(hits, None, hot_rows)
    return winners(usual).unionByName(winners(hot))
