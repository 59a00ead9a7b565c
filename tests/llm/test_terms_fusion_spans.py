import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docweft.llm import distinctive_terms as D
from docweft.llm import rank_fusion as R
from docweft.llm import shared_spans as S

REC = "rec_table string, rec_id string, text string"


def test_term_scores_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "bravos", "charlie", "delta", "echoes", "of", "Foxtrot"]
    rows = [("t" if i % 3 else "u", str(i), " ".join(rng.choice(words) for _ in range(15))) for i in range(40)]
    rows += [rows[0], ("t", "null", None), ("t", "empty", ""), ("t", None, "alpha alpha alpha")]
    d = spark.createDataFrame([(*r, "x") for r in rows], REC + ", score string")
    got = {(r.rec_table, r.rec_id, r.term): r for r in D.term_scores(d).collect()}
    recs = {(a, b): c for a, b, c in rows if b is not None}
    for t in ("t", "u"):
        own = {b: Counter(re.findall("[a-z]{5,}", (c or "").lower())) for (a, b), c in recs.items() if a == t}
        n = len(own)
        for b, c in own.items():
            for term, tf in c.items():
                df, cf = sum(term in x for x in own.values()), sum(x[term] for x in own.values())
                r = got.pop((t, b, term))
                assert (r.tf, r.df, r.cf, r.n_records) == (tf, df, cf, n)
                assert r.score == pytest.approx(tf * (math.log2(n / df) + math.log2(1 - math.exp(-cf / n))), abs=1e-9)
    assert not got


def test_common_terms_count_little(spark):
    rows = [("t", str(i), "common words " + ("rarest rarest rarest" if i == 0 else "other")) for i in range(50)]
    s = {(r.rec_id, r.term): r.rank for r in D.ranked_terms(D.term_scores(spark.createDataFrame(rows, REC))).collect()}
    assert s["0", "rarest"] == 1
    assert D.term_scores(spark.createDataFrame([], REC)).count() == 0


HIT = "hit_id bigint, query_id string, retriever string, chunk_id bigint, score double, points string"


def brute_borda(rows):
    best = {}
    for _, q, r, c, s, _ in rows:
        if None not in (q, r, c, s) and s == s:
            best[q, r, c] = max(s, best.get((q, r, c), -math.inf))
    out = {}
    for q in {k[0] for k in best}:
        items, rankers = {k[2] for k in best if k[0] == q}, {k[1] for k in best if k[0] == q}
        m, pts = len(items), {}
        for c in items:
            total = 0.0
            for r in rankers:
                l = {k[2]: v for k, v in best.items() if k[:2] == (q, r)}
                place = (m + 1) / 2 if c not in l else sum(v > l[c] for v in l.values()) + (sum(v == l[c] for v in l.values()) + 1) / 2
                total += m - place
            pts[c] = total
        for n, c in enumerate(sorted(pts, key=lambda c: (-pts[c], c)), 1):
            out[q, c] = (pts[c], n)
    return out


@pytest.mark.parametrize("hot_rows", [R.HOT_ROWS, 5])
def test_borda_against_brute_force(spark, hot_rows):
    rng = random.Random(9)
    rows = [(i, rng.choice("abc"), rng.choice("rst"), rng.randint(0, 9), rng.choice([None, 1.0, 2.0, 1e9, -5.0, float("nan"), rng.random()]), "x") for i in range(300)]
    rows += [(999, None, "r", 1, 1.0, "x"), (1000, "a", None, 1, 1.0, "x"), (1001, "a", "r", None, 1.0, "x")]
    got = {(r.query_id, r.chunk_id): (r.points, r.rank) for r in R.fuse(spark.createDataFrame(rows, HIT), hot_rows=hot_rows).collect()}
    assert got == brute_borda(rows)


@pytest.mark.parametrize("hot_rows", [R.HOT_ROWS, 5])
def test_the_widest_range_does_not_decide(spark, hot_rows):
    rows = []
    for r, scale in (("a", 1.0), ("b", 1.0), ("c", 1e6)):
        lead = [7, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11] if r != "c" else [99, 7, 1, 2, 3, 4]
        rows += [(len(rows), "q", r, c, scale * (20 - i), "") for i, c in enumerate(lead)]
    d = spark.createDataFrame(rows, HIT)
    assert [tuple(r) for r in R.outvoted_winners(d, hot_rows=hot_rows).collect()] == [("q", 7)]
    seen = rows + [(500, "q", "a", 99, 15.5, "")]  # now the item ahead is among another's ten best
    assert R.outvoted_winners(spark.createDataFrame(seen, HIT), hot_rows=hot_rows).count() == 0
    assert R.fuse(d.limit(0)).count() == 0


def brute_shared(recs, n):
    where = {}
    for k, t in recs.items():
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(k)
    out = {}
    for k, t in recs.items():
        covered = set()
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                covered |= set(range(i, i + n))
        out[k] = len(covered)
    return out


@pytest.mark.parametrize("length,period", [(12, 5), (20, 13), (200, 73), (200, 91)])
def test_shared_spans_against_brute_force(spark, length, period):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcdé字😀 ") for _ in range(length + rng.randint(-3, 9))) for _ in range(12)]
    rows = {("t", str(i)): "".join(rng.choice([rng.choice(pool), "".join(rng.choice("xyz ") for _ in range(rng.randint(0, length)))]) for _ in range(4)) for i in range(40)}
    rows |= {("u", "copy"): rows["t", "3"], ("u", "null"): None, ("u", "empty"): "", ("u", "self"): "q" * (3 * length)}
    data = [(a, b, t, 1) for (a, b), t in rows.items()] + [("t", "3", rows["t", "3"], 1)]
    d = spark.createDataFrame(data, REC + ", n_chars int").drop("n_chars").withColumn("shared_chars", F.lit(1))
    got = {(r.rec_table, r.rec_id): r.shared_chars for r in S.shared_spans(d, length, period).collect()}
    assert got == brute_shared(rows, length)


def test_difference_covers():
    for p in (2, 5, 13, 57, 73, 91, 133):
        c = S.difference_cover(p)
        assert {(a - b) % p for a in c for b in c} == set(range(p)) and len(c) <= 3 * p**0.5


def test_shared_spans_of_nothing(spark):
    assert S.shared_spans(spark.createDataFrame([], REC)).count() == 0
    with pytest.raises(ValueError):
        S.shared_spans(spark.createDataFrame([], REC), 50, 50)


def test_one_span_in_very_many_records(spark):
    """A span that all records have: every block sends one row of each of its hashes on, whatever the number of records."""
    n, span = 100_000, "The same notice stands in all of these records, word for word, at this place. "
    d = spark.range(n, numPartitions=4).select(F.lit("t").alias("rec_table"), F.col("id").cast("string").alias("rec_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(span)).alias("text"))
    r = S.shared_spans(d, 60, 13).agg(F.count(F.lit(1)).alias("n"), F.min("shared_chars").alias("lo"), F.avg("shared_chars").alias("mean")).first()
    assert r.n == n and len(span) <= r.lo and r.mean < len(span) + 6  # the few letters before agree with some other record's too
    long = d.select(F.xxhash64("text").alias("__class"), F.col("text").alias("__text"))
    most = long.mapInArrow(S._anchors(60, 13), "__k long, __class long, __v long").groupBy("__k").count().agg(F.max("count")).first()[0]
    assert most <= 60


def test_a_text_that_lost_its_id_is_no_record(spark):
    a, b = "a" * 30 + "xyz", "b" * 40
    rows = [("t", "1", a), ("t", "1", b), ("t", "2", "a" * 25 + "q"), ("t", "3", "b" * 25), (None, "4", "b" * 25), ("t", "5", None), ("t", "5", "b" * 26)]
    d = spark.createDataFrame(rows, REC)
    kept = min((a, b), key=lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
    got = {r.rec_id: (r.n_chars, r.shared_chars) for r in S.shared_spans(d, 20, 7).collect()}
    assert got == {"1": (len(kept), 30 if kept == a else 40), "2": (26, 25 if kept == a else 0), "3": (25, 25), "5": (26, 26)}
