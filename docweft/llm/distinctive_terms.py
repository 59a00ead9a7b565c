"""How distinctive a term is of a record: record frequency times residual inverse document frequency.

Residual idf is the observed idf less the idf that a Poisson spread of the term's
occurrences over all records would give, ``log2(N / df) + log2(1 - exp(-cf / N))``.  It is
near 0 for terms that fall evenly over the collection, common or rare, and large for
terms whose occurrences sit together in few records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.durable import stored
from docweft.llm._util import one_row_per_record
from docweft.operators.skew import join_stats

TERM = "[a-z]{5,}"


def residual_idf(n: Column, df: Column, cf: Column) -> Column:
    return F.log2(n / df) + F.log2(-F.expm1(-cf / n))


def term_scores(records: DataFrame, scope: str = "rec_table", rec: str = "rec_id", text: str = "text", pattern: str = TERM) -> DataFrame:
    """``scope, rec, term, tf, df, cf, n_records, ridf, score``: one row per term of each record.

    ``scope`` names the collection a record belongs to: frequencies never cross it.  Terms are
    matches of ``pattern`` in the lower-cased text.  A repeated record counts once; records with
    a null or empty text have no terms but count in ``n_records``; rows without an id are left out;
    other columns are ignored.  An empty table gives an empty result.
    """
    one = one_row_per_record(records, [scope, rec], text)
    sizes = one.groupBy(scope).agg(F.count(F.lit(1)).alias("n_records"))
    postings = (one.select(scope, rec, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))).alias("term"))
                .groupBy(scope, rec, "term").agg(F.count(F.lit(1)).alias("tf")))
    postings = stored(postings)  # five uses follow; without this each would read and split the texts again
    stats = stored(postings.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    scored = join_stats(postings, stats, [scope, "term"], "df", [rec]).join(sizes, scope)
    ridf = residual_idf(F.col("n_records").cast("double"), F.col("df"), F.col("cf"))
    return scored.withColumn("ridf", ridf).select(scope, rec, "term", "tf", "df", "cf", "n_records", "ridf", (F.col("tf") * F.col("ridf")).alias("score"))


def concentrated_terms(scores: DataFrame, min_tf: int = 3, max_df: int = 4, scope: str = "rec_table", rec: str = "rec_id") -> DataFrame:
    """``scope, rec, term`` of the terms that reach the score of the weakest one wanted: ``min_tf`` times in one record, once in each of ``max_df - 1`` others.

    The residual idf falls with the records that have a term and rises with its occurrences, so every wanted term reaches that score;
    what else does (more occurrences in more records) is then left out by its counts.
    """
    weakest = F.lit(min_tf) * residual_idf(F.col("n_records").cast("double"), F.lit(float(max_df)), F.lit(float(min_tf + max_df - 1)))
    enough = F.col("score") >= F.least(weakest, F.col("tf") / F.lit(min_tf) * weakest) - F.lit(1e-9)
    return scores.where(enough & (F.col("tf") >= min_tf) & (F.col("df") <= max_df)).select(scope, rec, "term")


def ranked_terms(scores: DataFrame, scope: str = "rec_table", rec: str = "rec_id") -> DataFrame:
    """``scores`` with each record's terms numbered by score at six places, ties by term.  A group is one record's terms."""
    w = W.partitionBy(scope, rec).orderBy(F.round("score", 6).desc(), "term")
    return scores.withColumn("rank", F.row_number().over(w))
