"""Ranks inside groups of any size.

A plain window sorts a whole group in one task.  Here a group is first cut into
buckets by a monotone function of the score, so that ranks come from two levels
of running totals: over the buckets of a group, and over the distinct scores of
a bucket.  Both are small however many rows the group has, and tied rows count
once per distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets per unit of ln(1 + |score|).
RESOLUTION = 4096


def score_bucket(score: Column) -> Column:
    """Ascending bucket number for descending scores; equal scores share a bucket."""
    s = F.greatest(F.least(score.cast("double"), F.lit(1e300)), F.lit(-1e300))
    return F.floor(-F.signum(s) * F.log1p(F.abs(s)) * F.lit(float(RESOLUTION))).cast("long")


def competition_ranks(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """One row per group and distinct score: ``n_tied``, ``min_rank`` and ``avg_rank``.

    The best (largest) score has rank 1; ``avg_rank`` is the mean of the places that tied
    rows share, ``min_rank`` the first of them.  Null scores must be removed before.
    """
    tied = df.groupBy(*group, score).agg(F.count(F.lit(1)).alias("n_tied")).withColumn("__b", score_bucket(F.col(score)))
    buckets = tied.groupBy(*group, "__b").agg(F.sum("n_tied").alias("__bn"))
    w1 = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("__ahead", F.coalesce(F.sum("__bn").over(w1), F.lit(0))).drop("__bn")
    w2 = W.partitionBy(*group, "__b").orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, -1)
    inside = tied.withColumn("__in", F.coalesce(F.sum("n_tied").over(w2), F.lit(0)))
    ahead = F.col("__ahead") + F.col("__in")
    return (inside.join(buckets, [*group, "__b"])
            .select(*group, score, "n_tied", (ahead + 1).alias("min_rank"), (ahead + (F.col("n_tied") + 1) / F.lit(2.0)).alias("avg_rank")))


def row_ranks(df: DataFrame, group: list[str], score: str, tie: str, out: str = "rank") -> DataFrame:
    """``df`` with its place in the group by ``score`` descending, then the whole number ``tie`` ascending.

    ``tie`` must be unique in its group and not null.  Equal scores are cut further by ranges
    of ``tie``, so a mass of ties is no single task's work either.
    """
    d = df.withColumn("__b", score_bucket(F.col(score))).withColumn("__t", F.floor(F.col(tie) / F.lit(65536)).cast("long"))
    cells = d.groupBy(*group, "__b", score, "__t").agg(F.count(F.lit(1)).alias("__n"))
    buckets = cells.groupBy(*group, "__b").agg(F.sum("__n").alias("__bn"))
    w1 = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("__ahead", F.coalesce(F.sum("__bn").over(w1), F.lit(0))).drop("__bn")
    w2 = W.partitionBy(*group, "__b").orderBy(F.col(score).desc(), "__t").rowsBetween(W.unboundedPreceding, -1)
    cells = (cells.withColumn("__in", F.coalesce(F.sum("__n").over(w2), F.lit(0))).drop("__n")
             .join(buckets, [*group, "__b"]).withColumn("__from", F.col("__ahead") + F.col("__in")).select(*group, "__b", score, "__t", "__from"))
    w3 = W.partitionBy(*group, "__b", score, "__t").orderBy(tie)
    return (d.withColumn("__at", F.row_number().over(w3)).join(cells, [*group, "__b", score, "__t"])
            .withColumn(out, (F.col("__from") + F.col("__at")).cast("long")).drop("__b", "__t", "__at", "__from"))
