import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import vectors as V
from docweft.operators import dense, fusion, lexical
from docweft.operators.ranking import competition_ranks, row_ranks
from docweft.operators.skew import join_stats


def one(spark, text, **cols):
    return spark.createDataFrame([(text,)], "t string").select(*[c(F.col("t")).alias(k) for k, c in cols.items()]).first()


def test_tokens_keep_codes_and_figures(spark):
    r = one(spark, "H1 income 2,417,090 up 33.5 FY24", a=T.tokens, b=lambda t: T.with_aliases(T.tokens(t)))
    assert r.a == ["h1", "income", "2,417,090", "up", "33.5", "fy24"]
    assert r.b == [*r.a, "first", "half", "interim", "sixmonth"]


def test_null_and_empty_texts(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "chunk_pos bigint, text string")
    assert [r.dl for r in lexical.document_lengths(d).orderBy("chunk_pos").collect()] == [0, 0]
    assert lexical.postings(d).count() == 0
    empty = d.limit(0)
    assert lexical.build(empty).terms.count() == 0


def test_norms_differ_in_what_they_keep(spark):
    r = one(spark, "  Mail: Info@shop.ug, Two (2) days! ", a=T.norm_anchor, s=T.norm_spaces, w=T.norm_words)
    assert r.a == "mail info@shop.ug two 2 days"
    assert r.s == "mail: info@shop.ug, two (2) days!"
    assert r.w == "mail info shop ug two 2 days"


@pytest.mark.parametrize("line,expected", [("3. Shipping and handling", True), ("Returns and Refunds", True), ("what now?", True), ("we sell lamps and bags", False), ("Ends with a stop.", False), ("", False), ("X " * 45, False)])
def test_headings(spark, line, expected):
    assert one(spark, line, h=T.is_heading).h is expected


@pytest.mark.parametrize("line,expected", [("Page 3 of 10", True), ("4 | Page", True), ("17", True), ("17 boxes", False)])
def test_furniture(spark, line, expected):
    assert one(spark, line, h=T.is_furniture).h is expected


def test_sentence_split_equals_the_pattern(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB.!? •-1\n") for _ in range(60)) for _ in range(300)]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.sentences(F.col("t")).alias("s")).collect()]
    assert got == [re.split(r"(?<=[.!?])\s+(?=[A-Z•●\-])", t) for t in texts]


def test_sizes_and_snippets(spark):
    d = spark.createDataFrame([(512,), (1536,), (5 * 1024**2,), (3 * 1024**4,)], "n bigint").select(T.human_bytes(F.col("n")).alias("s"))
    assert [r.s for r in d.collect()] == ["512 B", "1.5 KB", "5.0 MB", "3072.0 GB"]
    assert one(spark, "a  b\n" + "c" * 80, s=T.snippet).s == "a b " + "c" * 66 + "…"


CORPUS = [(0, "refund policy for returns"), (1, "delivery times and delivery fees"), (2, "privacy of data")]


def bm25(spark, docs, question, **kw):
    d = spark.createDataFrame(docs, "chunk_pos bigint, text string")
    q = spark.createDataFrame([("q", question)], "query_id string, question string")
    return {r.chunk_pos: r.score for r in lexical.scores(lexical.build(d, **kw), lexical.query_terms(q)).collect()}


def test_bm25_against_the_formula(spark):
    docs, k1, b = dict(CORPUS), 1.5, 0.75
    toks = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 3
    got = bm25(spark, CORPUS, "delivery delivery fees unknown")
    want = 0.0
    for t in ["delivery", "delivery", "fees"]:
        df = sum(t in x for x in toks.values())
        f = toks[1].count(t)
        want += math.log((3 - df + 0.5) / (df + 0.5) + 1) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(toks[1]) / avg))
    assert set(got) == {1} and got[1] == pytest.approx(want, abs=1e-6)


def test_aliases_only_on_documents(spark):
    assert set(bm25(spark, [(0, "H1 results"), (1, "other")], "first half")) == {0}
    assert bm25(spark, [(0, "first half"), (1, "other")], "h1") == {}


def test_idf_never_negative(spark):
    docs = [(i, "common") for i in range(4)]
    assert all(s >= 0 for s in bm25(spark, docs, "common").values())


def test_legacy_ranking_keeps_zero_scores(spark):
    d = spark.createDataFrame(CORPUS, "chunk_pos bigint, text string")
    q = spark.createDataFrame([("q", "privacy")], "query_id string, question string")
    r = [(x.chunk_pos, x.score > 0) for x in lexical.legacy_ranking(d, q, 3).orderBy("rank").collect()]
    assert r == [(2, True), (0, False), (1, False)]


def test_vectors(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, v array<float>")
    assert [list(r.n) for r in d.select(V.l2_normalize(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    g = dense.unit_norm_gate(d.select(F.col("v").alias("vec"))).first()
    assert (g.n_vectors, g.n_off, g.passed) == (2, 2, False)


@pytest.mark.parametrize("ranking", [dense.ranking, dense.block_ranking])
def test_dense_ranking_ties_and_exclusion(spark, ranking):
    v = spark.createDataFrame([(i, x) for i, x in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])], "chunk_pos bigint, vec array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], None)], "query_id string, qvec array<float>, own bigint")
    got = {(r.query_id, r.dense_place): r.chunk_pos for r in ranking(q, v, 2, exclude="own").collect()}
    assert got == {("a", 1): 1, ("a", 2): 3, ("b", 1): 2, ("b", 2): 3}


def lists(spark, **named):
    return spark.createDataFrame([("q", s, d, i + 1) for s, ds in named.items() for i, d in enumerate(ds)], "query_id string, source string, chunk_pos bigint, rank int")


def test_rrf_exact_value_ties_and_weights(spark):
    r = fusion.rrf(lists(spark, a=[1, 2, 3], b=[2, 1, 4])).orderBy("place").collect()
    assert [x.chunk_pos for x in r] == [1, 2, 3, 4]
    assert fusion.rrf(lists(spark, a=[7], b=[7])).first().rrf_score == pytest.approx(2 / 61)
    with pytest.raises(Exception, match="no weight"):
        fusion.rrf(lists(spark, a=[1], b=[1]), weights={"a": 1.0}).collect()


def test_hybrid_recovers_what_words_miss(spark):
    c = spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "gamma")], "chunk_pos bigint, text string")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1])], "chunk_pos bigint, vec array<float>")
    q = spark.createDataFrame([("q", "alpha", [0.0, 1.0])], "query_id string, question string, qvec array<float>")
    r = fusion.hybrid_search(q, lexical.build(c), v, c, k=2).orderBy("place").collect()
    assert [x.chunk_pos for x in r][:2] == [0, 1] and [x.slot for x in r] == ["hit", "hit", "considered"]


def test_rerank_moves_only_the_head(spark):
    d = spark.createDataFrame([("q", i, i + 1, s) for i, s in enumerate([0.1, 0.9, 0.9, 5.0])], "query_id string, chunk_pos bigint, place int, s double")
    assert [r.chunk_pos for r in fusion.rerank(d, 3, F.col("s")).orderBy("reranked").collect()] == [1, 2, 0, 3]


def test_ranks_in_groups_equal_a_plain_window(spark):
    rng = random.Random(1)
    rows = [("g%d" % (i % 3), i, rng.choice([0.0, -0.0, -3.5, 1e9, 0.25, rng.random()])) for i in range(400)]
    d = spark.createDataFrame(rows, "g string, i bigint, s double")
    got = {(r.g, r.i): r.rank for r in row_ranks(d, ["g"], "s", "i").collect()}
    for g in ("g0", "g1", "g2"):
        want = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))
        assert [got[g, x[1]] for x in want] == list(range(1, len(want) + 1))
    c = {(r.g, r.s): r.avg_rank for r in competition_ranks(d, ["g"], "s").collect()}
    top = [x for x in rows if x[0] == "g0" and x[2] == 1e9]
    assert c["g0", 1e9] == (len(top) + 1) / 2


def test_join_with_a_hot_key(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("k%d" % i, i) for i in range(500)], "k string, i int")
    stats = left.groupBy("k").count()
    j = join_stats(left, stats, ["k"], "count", ["i"], hot_share=0.1)
    assert j.count() == 1000 and j.where("k = 'hot' and count = 500").count() == 500
    assert join_stats(left.limit(0), stats.limit(0), ["k"], "count", ["i"]).count() == 0
