"""Retrieval evaluation: first gold rank, recall, reciprocal rank, strata, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
NO_RANK = 999


def first_gold_rank(ranked: DataFrame, questions: DataFrame, query: str = "query_id", doc: str = "chunk_pos", rank: str = "rank", gold: str = "gold_chunks", keep: tuple[str, ...] = ()) -> DataFrame:
    """``query, *keep, first_rank``: the best rank of a gold document, null if none is ranked; questions without gold are in it too."""
    golds = questions.select(query, F.explode(gold).alias(doc)).distinct()
    best = ranked.select(query, doc, rank).join(golds, [query, doc]).groupBy(query).agg(F.min(rank).alias("first_rank"))
    return questions.select(query, *keep).join(best, query, "left")


def _metrics(ks=KS):
    hit = [F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in ks]
    return [F.count(F.lit(1)).alias("n_questions"), *hit, F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("mrr")]


def recall_mrr(ranks: DataFrame, by: tuple[str, ...] = (), ks=KS, digits: int = 6) -> DataFrame:
    """Recall at each k and mean reciprocal rank; a question without a hit counts as a miss.  Empty input: nulls."""
    m = (ranks.groupBy(*by) if by else ranks).agg(*_metrics(ks))
    return m.select(*by, "n_questions", *[F.round(c, digits).alias(c) for c in [*(f"recall_at_{k}" for k in ks), "mrr"]])


def recall_rollup(ranks: DataFrame, stratum: str = "stratum", ks=KS) -> DataFrame:
    """Every stratum and, under ``all``, the whole."""
    m = ranks.rollup(stratum).agg(*_metrics(ks), F.grouping(stratum).alias("__g"))
    name = F.when(F.col("__g") == 1, F.lit("all")).otherwise(F.col(stratum))
    return m.select(name.alias(stratum), "n_questions", *[F.round(c, 6).alias(c) for c in [*(f"recall_at_{k}" for k in ks), "mrr"]])


def legacy_evaluate(ranked: DataFrame, questions: DataFrame, corpus: DataFrame, query: str = "query_id", doc: str = "chunk_pos", rank: str = "rank", gold: str = "gold_chunks", ks=KS) -> DataFrame:
    """The older count: questions without gold in the corpus are skipped but stay in the denominator."""
    there = questions.select(query, F.explode(gold).alias(doc)).distinct().join(corpus.select(doc), doc, "left_semi")
    best = ranked.select(query, doc, rank).join(there, [query, doc]).groupBy(query).agg(F.min(rank).alias("first_rank"))
    total = questions.agg(F.count(F.lit(1)).alias("n_total"))
    kept = there.agg(F.countDistinct(query).alias("n_graded"))
    hits = best.agg(*[F.coalesce(F.sum((F.col("first_rank") <= k).cast("long")), F.lit(0)).alias(f"h{k}") for k in ks], F.coalesce(F.sum(F.lit(1.0) / F.col("first_rank")), F.lit(0.0)).alias("rr"))
    one = total.crossJoin(kept).crossJoin(hits)
    n = F.greatest(F.lit(1), F.col("n_total"))
    return one.select("n_total", "n_graded", *[F.round(F.col(f"h{k}") / n, 6).alias(f"recall_at_{k}") for k in ks], F.round(F.col("rr") / n, 6).alias("mrr"))


def gold_coverage(ranked: DataFrame, questions: DataFrame, k: int = 5, query: str = "query_id", doc: str = "chunk_pos", rank: str = "rank", gold: str = "gold_chunks") -> DataFrame:
    """For questions with several gold documents: how many of them are among the best ``k``."""
    many = questions.where(F.size(gold) > 1)
    golds = many.select(query, F.explode(gold).alias(doc)).distinct()
    got = ranked.where(F.col(rank) <= k).select(query, doc).join(golds, [query, doc]).groupBy(query).agg(F.count(F.lit(1)).alias("n_found"))
    sizes = golds.groupBy(query).agg(F.count(F.lit(1)).alias("n_gold"))
    return sizes.join(got, query, "left").select(query, "n_gold", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def depth_stress(ranks: DataFrame, small: int = 3, large: int = 5, query: str = "query_id") -> DataFrame:
    """Questions a cut at ``small`` would lose (``beyond``) and those missed even at ``large``."""
    r = F.col("first_rank")
    why = F.when(r.isNull() | (r > large), F.lit(f"missed_at_{large}")).when(r > small, F.lit(f"beyond_{small}"))
    return ranks.withColumn("why", why).where("why is not null").select(query, "first_rank", "why")


def failures(ranks: DataFrame, k: int = 5) -> DataFrame:
    return ranks.where(F.col("first_rank").isNull() | (F.col("first_rank") > k))


def verdict(metrics: DataFrame, baseline: str, name: str = "retriever", ks=KS) -> DataFrame:
    """One row: the best other retriever among those that are nowhere worse than the baseline, by recall at 1 and then reciprocal
    rank; among all others if none is.  Ties by name."""
    cols = [*(f"recall_at_{k}" for k in ks), "mrr"]
    base = metrics.where(F.col(name) == baseline).select(*[F.col(c).alias(f"base_{c}") for c in cols])
    rest = metrics.where(F.col(name) != baseline).crossJoin(F.broadcast(base.limit(1)))
    clean = F.lit(True)
    for c in cols:
        clean = clean & (F.col(c) >= F.col(f"base_{c}"))
    w = W.orderBy(F.col("never_worse").desc(), F.col("recall_at_1").desc(), F.col("mrr").desc(), name)
    best = rest.withColumn("never_worse", clean).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    d = lambda c: F.round(F.col(c) - F.col(f"base_{c}"), 6).alias(f"delta_{c}")
    return best.select(name, "never_worse", d("recall_at_1"), d("recall_at_5"), d("mrr"))


def rerank_audit(base: DataFrame, reranked: DataFrame, query: str = "query_id", head: str = "head") -> DataFrame:
    """Per head size: questions whose first gold rank got better or worse, and those rescued from beyond ten."""
    a = base.select(query, F.coalesce("first_rank", F.lit(NO_RANK)).alias("before"))
    b = reranked.select(query, head, F.coalesce("first_rank", F.lit(NO_RANK)).alias("after"))
    n = lambda c: F.sum(c.cast("long"))
    return a.join(b, query).groupBy(head).agg(n(F.col("after") < F.col("before")).alias("improved"), n(F.col("after") > F.col("before")).alias("worsened"),
                                              n((F.col("before") > 5) & (F.col("after") <= 5)).alias("rescued"), F.count(F.lit(1)).alias("n_questions"))


def best_head(metrics: DataFrame, head: str = "head", latency: str = "latency_ms") -> DataFrame:
    """One row: the head size with the best recall at 5, at 3, reciprocal rank and then the least latency."""
    return metrics.agg(F.max_by(head, F.struct("recall_at_5", "recall_at_3", "mrr", -F.col(latency))).alias(head))


def stats_block(df: DataFrame, value: str, by: tuple[str, ...] = (), digits: int = 2) -> DataFrame:
    """Count, mean, exact median, least and largest of the values that are not null."""
    v = F.col(value).cast("double")
    r = lambda c, n: F.round(c, digits).alias(n)
    return (df.groupBy(*by) if by else df).agg(F.count(v).alias("n"), r(F.avg(v), "mean"), r(F.percentile(v, F.lit(0.5)), "median"), r(F.min(v), "min"), r(F.max(v), "max"))


def gold_map_hits(questions: DataFrame, retrieved: DataFrame, gold_map: DataFrame, query: str = "query_id", gold: str = "gold_chunks", pos: str = "chunk_pos", stable: str = "chunk_id") -> DataFrame:
    """``query, hit, n_mapped, n_unmapped``: was a gold document retrieved, over the ids that have a stable one.

    ``hit`` is null where there is no gold or none of it is mapped: neither a hit nor a miss.
    """
    g = questions.select(query, F.explode(gold).alias(pos)).distinct().join(gold_map.select(pos, stable), pos, "left")
    r = retrieved.select(query, stable).distinct().withColumn("__r", F.lit(1))
    per = g.join(r, [query, stable], "left").groupBy(query).agg(F.count(stable).alias("n_mapped"), F.sum(F.col(stable).isNull().cast("long")).alias("n_unmapped"), F.max("__r").alias("__hit"))
    j = questions.select(query).join(per, query, "left").na.fill(0, ["n_mapped", "n_unmapped"])
    return j.select(query, F.when(F.col("n_mapped") > 0, F.col("__hit").isNotNull()).alias("hit"), "n_mapped", "n_unmapped")


def migration_diff(old: DataFrame, new: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Chunks whose text differs between two versions, or that only one of them has."""
    j = old.select(*keys, F.col(text).alias("old_text")).join(new.select(*keys, F.col(text).alias("new_text")), keys, "full_outer")
    return j.where(~F.col("old_text").eqNullSafe(F.col("new_text")))


def unique_sources(hits: DataFrame, query: str = "query_id", source: tuple[str, ...] = ("filename", "page"), rank: str = "rank") -> DataFrame:
    """A query's distinct sources in the order they first appear."""
    w = W.partitionBy(query).orderBy("__r", *source)
    return hits.groupBy(query, *source).agg(F.min(rank).alias("__r")).withColumn("source_no", F.row_number().over(w)).drop("__r")
