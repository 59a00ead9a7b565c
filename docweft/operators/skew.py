"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so at most 1/HOT_SHARE keys are.
HOT_SHARE = 1 / 512
SALTS = 32


def join_stats(left: DataFrame, stats: DataFrame, keys: list[str], weight: str, spread: list[str],
               how: str = "inner", hot_share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """Join ``stats``, one row per key, to ``left``, many rows per key.

    ``weight`` (a column of ``stats``) is the number of rows a key has on the left.  Keys
    above ``hot_share`` of the total are salted: their left rows are spread by a hash of
    the ``spread`` columns, and their row of ``stats`` is repeated per salt.  What is
    broadcast is the list of hot keys, at most ``1 / hot_share`` rows whatever the input.
    Null keys never match, as in any equi-join.
    """
    total = stats.agg(F.sum(weight).alias("__total"))
    hot = (stats.crossJoin(F.broadcast(total)).where(F.col(weight) > F.col("__total") * F.lit(float(hot_share)))
           .select(*keys, F.lit(True).alias("__hot")))
    salted_left = (left.join(F.broadcast(hot), keys, "left")
                   .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
                   .drop("__hot"))
    salted_stats = (stats.join(F.broadcast(hot), keys, "left")
                    .withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
                    .drop("__hot"))
    return salted_left.join(salted_stats, [*keys, "__salt"], how).drop("__salt")
