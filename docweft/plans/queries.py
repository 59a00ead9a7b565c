"""Queries over the test tables, one or more per operator; whole tables, whole texts.

``corpus`` is ``chunks`` with repeated rows once; questions, answers and documents likewise.  A question's vector
is the row of ``embeddings`` with its number, which is then no candidate of that question.  Hybrid search ranks
the whole corpus for every question; what has no vector enters by its words alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.durable import scratch
from docweft.functions import text as T
from docweft.functions import vectors as V
from docweft.operators import chunking, dense, evaluation, fusion, gates, grading, labels, lexical, tables
from docweft.operators.index import ChunkIndex
from docweft.sources import files
from docweft.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "chunks").where("chunk_pos is not null").distinct()


def questions(spark, d) -> DataFrame:
    q = table(spark, d, "questions_sme_v3").where("id is not null").distinct().withColumnRenamed("id", "query_id")
    return q.withColumn("qnum", F.substring("query_id", 2, 20).cast("bigint"))


def answers(spark, d) -> DataFrame:
    return table(spark, d, "answers").where("answer_id is not null").distinct()


def extracted(spark, d) -> DataFrame:
    return table(spark, d, "extracted_docs").where("sha256 is not null").distinct()


def vectors(spark, d) -> DataFrame:
    """Vectors of the chunks that have one, by the chunk's number."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_pos"), F.col("embedding").alias("vec"))
    return e.join(corpus(spark, d).select("chunk_pos"), "chunk_pos", "left_semi")


def asked(spark, d) -> DataFrame:
    """Questions with a vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("qnum"), F.col("embedding").alias("qvec"))
    return questions(spark, d).join(e, "qnum")


def hit_lists(spark, d) -> DataFrame:
    """``query_id, source, chunk_pos, score, rank``: each retriever's list, a hit sent twice once, null scores left out."""
    h = table(spark, d, "hits").where("score is not null and query_id is not null and retriever is not null and chunk_id is not null")
    one = h.groupBy("query_id", F.col("retriever").alias("source"), F.col("chunk_id").alias("chunk_pos")).agg(F.max("score").alias("score"))
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "chunk_pos")
    return one.withColumn("rank", F.row_number().over(w))


def one_list(spark, d, source: str, rank: str = "rank") -> DataFrame:
    return hit_lists(spark, d).where(F.col("source") == source).withColumnRenamed("rank", rank)


# --- text


@query
def tokenize_terms(spark, d):
    return lexical.postings(corpus(spark, d), aliases=False).select("chunk_pos", "term", "tf", "dl")


@query
def tokenize_alias_expand(spark, d):
    return lexical.postings(corpus(spark, d)).select("chunk_pos", "term", "tf", "dl")


@query
def norm_variants(spark, d):
    t = F.col("text")
    return corpus(spark, d).select("chunk_pos", T.norm_anchor(t).alias("anchor"), T.norm_spaces(t).alias("spaces"), T.norm_words(t).alias("words"))


@query
def digit_density(spark, d):
    return corpus(spark, d).select("chunk_pos", F.round(T.digit_density(F.col("text")), 6).alias("density"))


@query
def furniture_filter(spark, d):
    lines = chunking.lines_of(table(spark, d, "documents"), "doc_id", "text")
    return lines.where(T.is_furniture(F.col("line"))).select("doc_id", "line_no", "line")


@query
def heading_predicate(spark, d):
    lines = chunking.lines_of(corpus(spark, d), "chunk_pos", "text")
    return lines.where(T.is_heading(F.col("line"))).select("chunk_pos", "line_no", "line")


@query
def sentence_split(spark, d):
    return corpus(spark, d).select("chunk_pos", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))


@query
def paragraph_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("par_no", "paragraph"))


@query
def heading_body_split(spark, d):
    h, b = T.heading_and_body(F.col("text"))
    return corpus(spark, d).select("chunk_pos", h.alias("heading"), b.alias("body"))


@query
def snippets(spark, d):
    return corpus(spark, d).select("chunk_pos", T.snippet(F.col("text")).alias("snippet"), T.token_estimate(F.col("text")).alias("n_tokens"))


@query
def human_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.human_bytes(F.length("text") * 1024).alias("size"))


@query
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.encode(F.col("text"), "UTF-8")).alias("sha256"))


# --- lexical


@query
def bm25_term_stats(spark, d):
    return lexical.build(corpus(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_doc_stats(spark, d):
    return lexical.document_lengths(corpus(spark, d))


@query
def bm25_corpus_stats(spark, d):
    return lexical.build(corpus(spark, d)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, d):
    return lexical.scores(lexical.build(corpus(spark, d)), lexical.query_terms(questions(spark, d)))


def _bm25_best(spark, d, depth):
    return lexical.ranking(lexical.build(corpus(spark, d), keep=True), lexical.query_terms(questions(spark, d)), depth)


@query
def bm25_scores(spark, d):
    return _bm25(spark, d).select("query_id", "chunk_pos", "score")


@query
def bm25_topk(spark, d):
    return _bm25_best(spark, d, 10).select("query_id", "chunk_pos", "score", "bm25_rank")


@query
def bm25_legacy_rank(spark, d):
    return lexical.legacy_ranking(corpus(spark, d), questions(spark, d), 10).select("query_id", "chunk_pos", "score", "rank")


# --- dense


@query
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return e.select("vec_id", "dim", F.round("x", 6).alias("x"))


@query
def unit_norm_gate(spark, d):
    return dense.unit_norm_gate(table(spark, d, "embeddings"), "embedding")


def _dense(spark, d, depth):
    return dense.block_ranking(asked(spark, d), vectors(spark, d), depth, exclude="qnum")


@query
def dense_topk(spark, d):
    return _dense(spark, d, 10).select("query_id", "chunk_pos", "sim", "dense_place")


@query
def encoder_stub_norms(spark, d):
    v = dense.encode(corpus(spark, d), dense.HashingEncoder(), "chunk_pos", "text")
    return v.select("chunk_pos", F.round(V.norm(F.col("vec")), 4).alias("norm"))


# --- fusion


@query
def rrf_fuse(spark, d):
    return fusion.rrf(hit_lists(spark, d)).select("query_id", "chunk_pos", F.round("rrf_score", 9).alias("rrf_score"), "place")


@query
def rrf_weighted(spark, d):
    w = {"bm25": 1.0, "dense": 2.0, "cross_encoder": 0.5, "legacy_bm25": 0.25}
    return fusion.rrf(hit_lists(spark, d), weights=w).select("query_id", "chunk_pos", F.round("rrf_score", 9).alias("rrf_score"), "place")


@query
def rrf_two_lists(spark, d):
    f = fusion.fuse_two(one_list(spark, d, "bm25", "bm25_rank"), one_list(spark, d, "dense", "dense_place"))
    return f.select("query_id", "chunk_pos", "bm25_rank", "dense_place", F.round("rrf_score", 9).alias("rrf_score"), "place")


def _hybrid(spark, d):
    c = corpus(spark, d)
    q = questions(spark, d).join(asked(spark, d).select("query_id", F.col("qnum").alias("own"), "qvec"), "query_id", "left")
    return fusion.hybrid_search(q, lexical.build(c, keep=True), vectors(spark, d), c.select("chunk_pos", "doc", "page"), exclude="own")


@query
def hybrid_search_topk(spark, d):
    return _hybrid(spark, d).where("slot = 'hit'").select("query_id", "chunk_pos", "bm25_rank", "dense_place", F.round("rrf_score", 9).alias("rrf_score"), "place", "doc", "page")


@query
def search_hits_considered(spark, d):
    return _hybrid(spark, d).select("query_id", "slot", "place", "chunk_pos")


@query
def bm25_only_fallback(spark, d):
    r = fusion.lexical_only(_bm25_best(spark, d, fusion.CANDIDATE_DEPTH), 5)
    return r.select("query_id", "chunk_pos", "bm25_rank", F.round("rrf_score", 9).alias("rrf_score"))


def _reranked(spark, d, head):
    base = fusion.fuse_two(one_list(spark, d, "bm25", "bm25_rank"), one_list(spark, d, "dense", "dense_place"))
    ce = one_list(spark, d, "cross_encoder").select("query_id", "chunk_pos", F.col("score").alias("ce_score"))
    return fusion.rerank(base.join(ce, ["query_id", "chunk_pos"], "left"), head, F.col("ce_score"))


@query
def rerank_head_tail(spark, d):
    return _reranked(spark, d, 10).select("query_id", "chunk_pos", "place", "reranked")


# --- evaluation


def _ranks(spark, d, source):
    return evaluation.first_gold_rank(one_list(spark, d, source), questions(spark, d), keep=("stratum",))


@query
def first_gold_rank(spark, d):
    return _ranks(spark, d, "bm25")


def _answerable(spark, d):
    return questions(spark, d).where("size(gold_chunks) > 0")


def _all_ranks(spark, d):
    """First gold ranks of every retriever for every answerable question."""
    names = ["bm25", "dense", "cross_encoder", "legacy_bm25"]
    q = _answerable(spark, d).withColumn("source", F.explode(F.array(*map(F.lit, names)))).withColumn("qs", F.concat_ws("|", "source", "query_id"))
    ranked = hit_lists(spark, d).withColumn("qs", F.concat_ws("|", "source", "query_id"))
    return evaluation.first_gold_rank(ranked, q, query="qs", keep=("source", "stratum"))


@query
def recall_mrr(spark, d):
    return evaluation.recall_mrr(_all_ranks(spark, d), ("source",))


@query
def recall_by_stratum(spark, d):
    return evaluation.recall_rollup(evaluation.first_gold_rank(one_list(spark, d, "cross_encoder"), _answerable(spark, d), keep=("stratum",)))


@query
def legacy_evaluate(spark, d):
    return evaluation.legacy_evaluate(one_list(spark, d, "legacy_bm25"), questions(spark, d), corpus(spark, d))


@query
def gold_coverage_at5(spark, d):
    return evaluation.gold_coverage(one_list(spark, d, "bm25"), questions(spark, d))


@query
def k3_stress(spark, d):
    return evaluation.depth_stress(evaluation.first_gold_rank(one_list(spark, d, "dense"), _answerable(spark, d)))


@query
def failure_list(spark, d):
    return evaluation.failures(evaluation.first_gold_rank(one_list(spark, d, "bm25"), _answerable(spark, d)))


@query
def retriever_verdict(spark, d):
    return evaluation.verdict(evaluation.recall_mrr(_all_ranks(spark, d), ("source",)), "bm25", "source")


def _rerank_ranks(spark, d):
    out = None
    for n in (10, 15, 20):
        r = evaluation.first_gold_rank(_reranked(spark, d, n).withColumn("rank", F.col("reranked")), _answerable(spark, d)).withColumn("head", F.lit(n))
        out = r if out is None else out.unionByName(r)
    return out


@query
def rerank_audit(spark, d):
    base = evaluation.first_gold_rank(_reranked(spark, d, 10).withColumn("rank", F.col("place")), _answerable(spark, d))
    return evaluation.rerank_audit(base, _rerank_ranks(spark, d))


@query
def best_rerank_n(spark, d):
    m = evaluation.recall_mrr(_rerank_ranks(spark, d), ("head",)).withColumn("latency_ms", F.col("head") * 1.0)
    return evaluation.best_head(m)


# --- chunking


def _streams(spark, d):
    return chunking.document_stream(chunking.clean_lines(chunking.lines_of(table(spark, d, "documents").where("text is not null"), "doc_id", "text")), "doc_id")


@query
def document_stream(spark, d):
    return _streams(spark, d)


@query
def section_cut(spark, d):
    return chunking.sections(_streams(spark, d), "doc_id", title=F.lit("doc"))


def _plain_segments(spark, d):
    return _streams(spark, d).select("doc_id", F.lit("doc").alias("heading"), F.col("stream").alias("body"))


def _packed(spark, d):
    p = chunking.pack_sentences(_plain_segments(spark, d))
    return p.select("doc_id", F.posexplode("chunks").alias("ordinal", "text")).withColumn("n_tokens", T.token_estimate(F.col("text")))


@query
def pack_sentences(spark, d):
    return _packed(spark, d)


@query
def over_budget_chunks(spark, d):
    return chunking.over_budget(_packed(spark, d)).select("doc_id", "ordinal", "n_tokens")


@query
def chunk_offsets(spark, d):
    return chunking.body_offsets(_packed(spark, d), _streams(spark, d), "doc_id").select("doc_id", "ordinal", "char_start", "char_end")


def _paged_lines(spark, d):
    """Chunks of a file as its lines, on the pages they carry."""
    c = corpus(spark, d).where("doc is not null and text is not null")
    return c.select("doc", F.coalesce("page", F.lit(0)).alias("page"), F.col("chunk_pos").alias("line_no"), F.col("text").alias("line"))


@query
def line_offsets(spark, d):
    return chunking.line_offsets(_paged_lines(spark, d)).select("doc", "line_no", "line_start")


@query
def page_of_offset(spark, d):
    lines = chunking.line_offsets(_paged_lines(spark, d))
    points = lines.select("doc", (F.col("line_start") + 100).cast("long").alias("at"))
    return chunking.page_of_offset(points, lines)


@query
def corpus_fingerprint(spark, d):
    return chunking.corpus_fingerprint(corpus(spark, d).where("text is not null"))


@query
def tree_fingerprint(spark, d):
    return chunking.tree_fingerprint(corpus(spark, d))


@query
def chunk_metrics(spark, d):
    return chunking.chunk_metrics(corpus(spark, d).withColumn("n_tokens", T.token_estimate(F.col("text"))))


@query
def stable_chunk_ids(spark, d):
    e = extracted(spark, d).select("sha256", F.posexplode("chunks").alias("ordinal", "c"))
    return chunking.stable_ids(e).select("chunk_id", "sha256", "ordinal", "c.page", "c.char_start", "c.char_end")


@query
def document_row_ranges(spark, d):
    from pyspark.sql import Window as W

    # two levels: the documents whose hashes begin alike, and the at most 4096 such beginnings
    n = extracted(spark, d).select("sha256", F.size("chunks").alias("n_chunks"), F.substring("sha256", 1, 3).alias("start"))
    before = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    starts = n.groupBy("start").agg(F.sum("n_chunks").alias("rows")).withColumn("ahead", F.coalesce(F.sum("rows").over(before(F.lit(0), "start")), F.lit(0))).drop("rows")
    inside = n.withColumn("within", F.coalesce(F.sum("n_chunks").over(before("start", "sha256")), F.lit(0))).join(F.broadcast(starts), "start")
    return inside.withColumn("first_row", F.col("ahead") + F.col("within")).select("sha256", "n_chunks", "first_row", (F.col("first_row") + F.col("n_chunks")).alias("end_row"))


# --- tables


def _nation_tables(spark, d):
    """A raw table per region with a two-row header, cells with stray blanks, and a spacer row."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.array(F.concat(F.lit(" "), F.col("n_name"), F.lit("  ")), F.col("n_nationkey").cast("string"), F.lit(""), (F.col("n_nationkey") * 1000).cast("string"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda s: s["r"])
    head = F.array(F.array(F.lit(""), F.lit("Key"), F.lit("Note"), F.lit("Size")), F.array(F.lit(""), F.lit("number"), F.lit(""), F.lit("units")), F.array(F.lit(""), F.lit(""), F.lit(""), F.lit("")))
    return n.groupBy("r_name").agg(F.concat(head, body).alias("rows"))


def _part_tables(spark, d):
    """A raw table per brand whose header labels its stub."""
    row = F.array("p_name", F.col("p_size").cast("string"), "p_type")
    body = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda s: s["r"])
    return table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.array(F.array(F.lit("Name"), F.lit("Size"), F.lit("Type"))), body).alias("rows"))


@query
def header_span(spark, d):
    a = _nation_tables(spark, d).select(F.col("r_name").alias("name"), tables.header_span(F.col("rows")).alias("s"))
    b = _part_tables(spark, d).select(F.col("p_brand").alias("name"), tables.header_span(F.col("rows")).alias("s"))
    return a.unionByName(b).select("name", "s.start", "s.stop")


@query
def merge_header_stack(spark, d):
    r = F.col("rows")
    return _nation_tables(spark, d).select("r_name", F.posexplode(tables.merge_headers(r, tables.header_span(r))).alias("col_no", "header"))


@query
def serialise_table(spark, d):
    return _nation_tables(spark, d).select("r_name", tables.serialise(F.col("rows")).alias("text"))


@query
def serialise_labelled_stub(spark, d):
    return _part_tables(spark, d).select("p_brand", tables.serialise(F.col("rows")).alias("text"))


@query
def render_pipe_table(spark, d):
    return _nation_tables(spark, d).select("r_name", tables.render_pipes(F.col("rows")).alias("text"))


@query
def real_table_filter(spark, d):
    return _nation_tables(spark, d).select("r_name", tables.is_real_table(F.col("rows")).alias("is_real"), tables.is_real_table(F.slice(F.col("rows"), 1, 1)).alias("header_is_real"))


@query
def outside_boxes(spark, d):
    """Points outside the boxes of their page, over line items as points."""
    pts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("cx"), (F.col("l_discount") * 100).alias("cy"))
    box = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("page"), ((F.col("r_regionkey") + 1) * 8.0).alias("x0"), ((F.col("r_regionkey") + 1) * 8.0 + 10).alias("x1"), F.lit(1.5).alias("top"), F.lit(6.5).alias("bottom"))
    return tables.outside_boxes(pts, box).groupBy("page").agg(F.count(F.lit(1)).alias("n_outside"), F.sum("l_orderkey").alias("key_sum"))


# --- gates


#: Texts that gates must and must not fire on, since the tables hold few of them: (number, text).
SAMPLES = [
    (-1, "1.1 Returns . . . . . . . . . . 4\n1.2 Fees and charges . . . . . . 9"), (-2, "List of maps\n3.4 Yards of the north ........ 17"), (-3, ". . . . . 12"), (-4, "Fees.... see below, as they are due on Monday"),
    (-5, "Returned goods 4,120 3,998 12.5% 880 912 7.1%\nSold goods 9,411 8,207 14.7% 1,204 1,180 2.0%"), (-6, "Returned goods | May: 4,120 | June: 3,998 | Change: 12.5%"), (-7, "Sales rose by 14.7% because lamps sold well."),
    (-8, "12 lamps | col1: paid 30 units paid 28 units"), (-9, "Costs went up Freigh 40.5 | .3 units: ted"), (-10, "Board members | a Lamps sold.: a Fees rose."), (-11, "Lamp\u00a0shades | Unit:\u00a04 | Unit: 5"), (-12, "Lamp shades | Unit May: 4 | Unit June: 5"),
]


def _samples(spark):
    return spark.createDataFrame(SAMPLES, "key bigint, text string")


@query
def front_matter(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").unionByName(_samples(spark))
    return texts.where(gates.is_front_matter(F.col("text"))).select(F.col("key").alias("doc_id"))


@query
def orphan_digit_wall(spark, d):
    # the figures of a table without their labels, next to samples
    walls = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "O", F.lit("status:")).otherwise(F.lit("open"))).alias("text"))
    return walls.unionByName(_samples(spark)).where(gates.is_orphan_digit_wall(F.col("text"))).select("key")


def _chunks_and_samples(spark, d):
    return corpus(spark, d).select("chunk_pos", "text").unionByName(_samples(spark).withColumnRenamed("key", "chunk_pos"))


@query
def garbled_labels(spark, d):
    return _chunks_and_samples(spark, d).where(gates.is_garbled(F.col("text"))).select("chunk_pos")


@query
def ambiguous_headers(spark, d):
    return _chunks_and_samples(spark, d).where(gates.has_ambiguous_headers(F.col("text"))).select("chunk_pos")


@query
def gate_flags(spark, d):
    return corpus(spark, d).where("text is not null").select("chunk_pos", gates.flag(F.col("text")).alias("gate"))


@query
def gate_report(spark, d):
    return gates.gate_report(corpus(spark, d))


@query
def gold_smear_gate(spark, d):
    # one question's gold list is smeared over a fourth of the corpus
    n = corpus(spark, d).count()
    q = questions(spark, d).select("query_id", "gold_chunks")
    smeared = spark.range(1).select(F.lit("smeared").alias("query_id"), F.sequence(F.lit(0), F.lit(3 + n // 4)).cast("array<bigint>").alias("gold_chunks"))
    return gates.gold_smear(q.unionByName(smeared), n).select("query_id")


@query
def gold_missing_gate(spark, d):
    return gates.gold_missing(questions(spark, d), corpus(spark, d).where("kind = 'clause'"), "query_id")


@query
def unique_id_gate(spark, d):
    e = chunking.stable_ids(extracted(spark, d).select("sha256", F.posexplode("chunks").alias("ordinal", "c")))
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("chunk_id").alias("n_ids"))


# --- labels


@query
def verbatim_label(spark, d):
    v = labels.verbatim_labels(questions(spark, d), corpus(spark, d), "query_id")
    return v.select("query_id", "span", F.explode("chunks").alias("chunk_pos"))


@query
def anchor_label(spark, d):
    a = labels.anchor_labels(questions(spark, d), corpus(spark, d), "query_id")
    return a.select("query_id", "anchor", F.explode("chunks").alias("chunk_pos"))


@query
def autolabel_tiers(spark, d):
    return labels.autolabel(questions(spark, d), corpus(spark, d), "query_id").select("query_id", "tier", "matched")


@query
def label_review(spark, d):
    # next to the labels as they are, each with its gold list moved on by one chunk, half of those without their claimed span
    q = questions(spark, d).select("query_id", "answer", "gold_chunks", "qnum", F.col("evidence.matched_span").alias("matched_span"))
    moved = q.select(F.concat(F.lit("moved "), "query_id").alias("query_id"), "answer", F.transform("gold_chunks", lambda x: x + 1).alias("gold_chunks"), "qnum", F.when(F.col("qnum") % 2 == 0, F.col("matched_span")).alias("matched_span"))
    return labels.label_review(q.unionByName(moved), corpus(spark, d), "query_id")


@query
def answer_candidates(spark, d):
    return labels.answer_candidates(questions(spark, d), corpus(spark, d), 6, key="query_id")


@query
def weak_candidates(spark, d):
    return labels.answer_candidates(questions(spark, d), corpus(spark, d), 5, weak=True, key="query_id")


# --- grading


def _graded(spark, d):
    return grading.layer_a(answers(spark, d), corpus(spark, d))


@query
def layer_a_verdict(spark, d):
    return _graded(spark, d).select("answer_id", "a_verdict", "a_abstained", F.round("a_ratio", 4).alias("a_ratio"))


@query
def abstention_variants(spark, d):
    a = F.col("answer")
    return answers(spark, d).where("answer is not null").select("answer_id", grading.abstained_prefix(a).alias("prefix"), grading.abstained(a).alias("anywhere"), grading.laundered(a).alias("laundered"))


def _judged(spark, d):
    """A judge's replies as a deterministic stand-in gives them: JSON in some prose, now and then none."""
    said = F.when(F.length("answer") % 11 == 0, F.lit("I cannot tell.")).otherwise(
        F.concat(F.lit('Verdict follows. {"verdict": "'), F.when(F.col("a_abstained"), F.when(F.size("gold_chunks") == 0, F.lit("CORRECT_ABSTENTION")).otherwise(F.lit("WRONG_ABSTENTION")))
                 .when(F.length("answer") % 3 == 0, F.lit("UNFAITHFUL")).otherwise(F.lit("FAITHFUL")), F.lit('", "evidence": "none", "reason": "rule"} Done.')))
    g = _graded(spark, d).where("answer is not null").withColumn("raw", said)
    return g.withColumn("b_verdict", grading.parse_judge(F.col("raw"))["verdict"])


@query
def parse_judge(spark, d):
    return _judged(spark, d).select("answer_id", "b_verdict")


class ContainmentJudge:
    """A stand-in for a judging model: an answer is faithful if it stands in the passages as it is."""

    def complete(self, system: str, user: str) -> str:
        passages, _, rest = user.partition("\n\nQuestion: ")
        answer = rest.partition("\n\nAnswer: ")[2]
        verdict = "CORRECT_ABSTENTION" if not passages.removeprefix("Passages:\n") else "FAITHFUL" if answer.lower() in passages.lower() else "UNFAITHFUL"
        return f'It is so: {{"verdict": "{verdict}", "evidence": "", "reason": "containment"}}' if answer else "There is nothing to judge."


@query
def judge_verdicts(spark, d):
    a = answers(spark, d).select("answer_id", "question", "answer", "gold_chunks")
    gold = a.select("answer_id", F.posexplode("gold_chunks").alias("rank", "chunk_pos")).join(corpus(spark, d).select("chunk_pos", "text"), "chunk_pos")
    asked_ = a.join(grading.contexts(gold.withColumnRenamed("answer_id", "query_id")).withColumnRenamed("query_id", "answer_id"), "answer_id", "left")
    return grading.judge(asked_, ContainmentJudge).select("answer_id", "b_verdict")


@query
def judge_reconcile(spark, d):
    return grading.reconcile(_judged(spark, d)).select("answer_id", "a_bin", "b_bin", "agree", "needs_review")


@query
def agreement_report(spark, d):
    return grading.agreement_report(grading.reconcile(_judged(spark, d)))


@query
def run_comparison(spark, d):
    return grading.run_summary(_graded(spark, d))


@query
def run_comparison_by_stratum(spark, d):
    return grading.run_summary(_graded(spark, d), ("prompt_version", "stratum")).select("prompt_version", "stratum", "answerable", "passed", "passed_pct")


@query
def run_churn(spark, d):
    runs = ["v1", "v2", "v3"]
    return grading.churn(_graded(spark, d), runs)


@query
def human_tally(spark, d):
    # the people's verdict is stood in for by whether the gold answer stands in the answer
    said = F.when(F.lower("answer").contains(F.lower("gold_answer")), F.lit("CORRECT")).when(F.col("gold_answer").isNull(), F.lit("LABEL ISSUE")).otherwise(F.lit("UNGROUNDED"))
    return grading.human_tally(_graded(spark, d).where("answer is not null").withColumn("human_verdict", said))


@query
def context_assembly(spark, d):
    h = one_list(spark, d, "bm25").where("rank <= 3").join(corpus(spark, d).select("chunk_pos", "text"), "chunk_pos")
    return grading.contexts(h).select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


@query
def context_by_chunk_id(spark, d):
    h = one_list(spark, d, "bm25").where("rank <= 3").join(corpus(spark, d).select("chunk_pos", "text"), "chunk_pos")
    return grading.contexts(h, number="chunk_pos").select("query_id", F.md5("context").alias("context_md5"))


@query
def prompt_fill(spark, d):
    c = answers(spark, d)
    text = grading.fill("Question: {question}\nAnswer: {answer}", question=F.col("question"), answer=F.col("answer"))
    return c.select("answer_id", text.alias("prompt"))


# --- operations


@query
def resume_antijoin(spark, d):
    done = answers(spark, d).where("prompt_version = 'v1' and gen_seconds is not null").select(F.col("id").alias("query_id"))
    return labels.pending(questions(spark, d), done, "query_id").select("query_id")


@query
def gold_map_tristate(spark, d):
    gold_map = corpus(spark, d).where("kind = 'clause'").select("chunk_pos", F.concat(F.lit("c:"), F.col("chunk_pos").cast("string")).alias("chunk_id"))
    got = one_list(spark, d, "dense").where("rank <= 5").select("query_id", F.concat(F.lit("c:"), F.col("chunk_pos").cast("string")).alias("chunk_id"))
    return evaluation.gold_map_hits(questions(spark, d), got, gold_map).withColumn("hit", F.col("hit").cast("int"))


@query
def stats_block(spark, d):
    return evaluation.stats_block(answers(spark, d), "gen_seconds", ("prompt_version",))


@query
def event_stats(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return evaluation.stats_block(e, "k", ("event_type",))


@query
def unique_sources(spark, d):
    h = one_list(spark, d, "bm25").where("rank <= 10").join(corpus(spark, d).select("chunk_pos", F.col("doc").alias("filename"), "page"), "chunk_pos").where("page is not null and filename is not null")
    return evaluation.unique_sources(h)


@query
def migration_diff(spark, d):
    old = corpus(spark, d).select("chunk_pos", "text")
    new = old.select("chunk_pos", F.when(F.col("chunk_pos") % 10 == 0, F.rtrim("text")).otherwise(F.col("text")).alias("text")).where("chunk_pos % 97 <> 5")
    return evaluation.migration_diff(old, new, ["chunk_pos"]).select("chunk_pos", F.length("old_text").alias("old_len"), F.length("new_text").alias("new_len"))


@query
def gen_tps(spark, d):
    ns = F.when(F.col("gen_seconds") > 0, F.col("gen_seconds") * 1e9)
    return answers(spark, d).select("answer_id", grading.tokens_per_second(T.token_estimate(F.col("answer")), ns).alias("tps"))


@query
def dump_records(spark, d):
    return files.dump_lines(corpus(spark, d).where("text is not null and doc is not null")).select("chunk_pos", F.md5("record").alias("record_md5"))


@query
def document_frequency_ceiling(spark, d):
    toks = corpus(spark, d).where("text is not null").select("chunk_pos", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    n = corpus(spark, d).agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * F.lit(0.3))).alias("most"))
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where("df > most").select("term", "df")


@query
def token_set_ops(spark, d):
    """Union, intersection and difference of the tokens of a question and of its gold chunks."""
    g = questions(spark, d).select("query_id", "question", F.explode("gold_chunks").alias("chunk_pos")).join(corpus(spark, d).select("chunk_pos", "text"), "chunk_pos")
    s = g.groupBy("query_id", "question").agg(F.array_distinct(F.flatten(F.collect_list(T.words(F.col("text"))))).alias("gold"))
    q = F.array_distinct(T.words(F.col("question")))
    return s.select("query_id", F.size(F.array_union(q, F.col("gold"))).alias("n_union"), F.size(F.array_intersect(q, F.col("gold"))).alias("n_both"), F.size(F.array_except(q, F.col("gold"))).alias("n_only_question"))


# --- index and streams: written to the shared folder and read again


@query
def index_append_idempotent(spark, d):
    """Documents appended in two overlapping parts: what the index then holds."""
    docs = table(spark, d, "extracted_docs")
    index = ChunkIndex.open(spark, scratch(spark))
    index.append(docs.where("pages is not null"))
    index.append(docs)
    return index.table("chunks").select("chunk_id", "doc_sha256", "filename", "page", "char_start", "char_end")


@query
def index_stats(spark, d):
    index = ChunkIndex.open(spark, scratch(spark))
    index.append(table(spark, d, "extracted_docs"))
    s = index.stats()
    return spark.createDataFrame([(s["n_documents"], s["n_chunks"])], "n_documents bigint, n_chunks bigint")


@query
def search_persisted(spark, d):
    index = ChunkIndex.open(spark, scratch(spark))
    index.append(table(spark, d, "extracted_docs"), dense.HashingEncoder())
    q = questions(spark, d).select("query_id", "question")
    return index.search(q, 5, dense.HashingEncoder()).select("query_id", "chunk_id", "bm25_rank", "dense_place", F.round("rrf_score", 9).alias("rrf_score"), "place", "slot")


@query
def search_persisted_lexical(spark, d):
    index = ChunkIndex.open(spark, scratch(spark))
    index.append(table(spark, d, "extracted_docs"))
    r = index.search(questions(spark, d).select("query_id", "question"), 5)
    return r.select("query_id", "chunk_id", "bm25_rank", F.round("rrf_score", 9).alias("rrf_score"), "slot", "filename", "page")


@query
def stream_ingest_dedup(spark, d):
    """Documents as a stream, each content once."""
    out = scratch(spark)
    schema = table(spark, d, "documents").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/document[s].parquet")  # a pattern, since a stream reads no single file
    one = ingest.distinct_contents(s).select("sha256")
    q = one.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query
def event_windows(spark, d):
    e = ingest.event_counts(table(spark, d, "events"))
    return e.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
