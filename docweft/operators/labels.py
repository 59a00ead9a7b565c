"""Gold labels by proof: verbatim spans, rare anchors, else abstain; reviews of existing labels; resume sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import blocks, overlap, runs
from docweft.session import ships

# How rare and how long proof has to be.
MIN_SPAN_WORDS = 4
MAX_HITS = 3
MAX_DF_SHARE = 0.15
REVIEW_DF_SHARE = 0.30
#: Chunks, characters of chunks, and answers in a block where runs are looked for.
RUN_BLOCK, RUN_CHARS, ANSWER_BLOCK = 1 << 12, 1 << 22, 1 << 15


def verbatim_labels(questions: DataFrame, chunks: DataFrame, key: str = "id", answer: str = "answer", doc: str = "chunk_pos", text: str = "text", least: int = MIN_SPAN_WORDS, max_hits: int = MAX_HITS) -> DataFrame:
    """``key, span, chunks``: the longest, then leftmost, run of at least ``least`` (4 or more) of the answer's words that stands
    in at least one and at most ``max_hits`` chunks.

    The match is of substrings of normalised texts, so a run's edge words may be parts of longer ones, but its inner words are
    whole wherever it stands.  A longer run from the same start stands in no more chunks, so of each start only the longest run that
    any chunk has is counted (``runs``), by blocks of chunks.  Null answers and texts match nothing.
    """
    if least < 4:
        raise ValueError("runs need two inner words")
    q = questions.where(F.col(answer).isNotNull()).select(key, T.norm_anchor(F.col(answer)).alias("__a")).where(F.size(F.split("__a", " ")) >= least)
    once = q.select("__a").distinct()
    texts = chunks.where(F.col(text).isNotNull()).select(doc, T.norm_anchor(F.col(text)).alias("__t"))
    kind = chunks.schema[doc].dataType.simpleString()

    def run(d: pa.Table, a: pa.Table) -> pa.Table:
        which, start, size, n, found = runs.longest_runs(d.column("__t").to_pylist(), a.column("__a").to_pylist(), least, max_hits)
        few = np.where(n <= max_hits, n, 0)
        docs = d.column(doc).combine_chunks().take(pa.array(found[np.arange(max_hits) < few[:, None]]))
        found_in = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(few)], pa.int32()), docs)
        return pa.table([a.column("__a").take(pa.array(which)), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(n), found_in], names=["__a", "start", "size", "n", "docs"])

    pairs = overlap.block_sizes(texts, "__t", once, RUN_BLOCK, RUN_CHARS, ANSWER_BLOCK)
    here = blocks.paired(texts, once, doc, "__a", pairs, run, f"__a string, start int, size int, n bigint, docs array<{kind}>").repartition("__a")
    lengths = here.groupBy("__a", "start", "size").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("docs")).alias("docs"))
    longest = lengths.groupBy("__a", "start").agg(F.max_by(F.struct("size", "n", "docs"), "size").alias("r")).where(F.col("r.n") <= max_hits)
    best = longest.groupBy("__a").agg(F.min_by(F.struct("start", "r.size", "r.docs"), F.struct(-F.col("r.size"), F.col("start"))).alias("b"))
    span = F.array_join(F.slice(F.split("__a", " "), F.col("b.start") + 1, F.col("b.size")), " ")
    return q.join(best, "__a").select(key, span.alias("span"), F.array_sort("b.docs").alias("chunks"))


def anchor_labels(questions: DataFrame, chunks: DataFrame, key: str = "id", answer: str = "answer", doc: str = "chunk_pos", text: str = "text", max_hits: int = MAX_HITS) -> DataFrame:
    """``key, anchor, chunks``: the longest structured token (address, figure, identifier) of the answer that few chunks have."""
    a = questions.where(F.col(answer).isNotNull()).select(key, F.explode(T.distinctive_tokens(T.norm_anchor(F.col(answer)))).alias("anchor")).where(T.is_structured(F.col("anchor")))
    toks = chunks.where(F.col(text).isNotNull()).select(doc, F.explode(F.array_distinct(F.split(T.norm_anchor(F.col(text)), " "))).alias("anchor"))
    ceiling = chunks.agg(F.least(F.lit(max_hits), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(MAX_DF_SHARE)))).alias("most"))
    rare = toks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(ceiling)).where("n <= most").select("anchor")
    hits = a.join(rare, "anchor", "left_semi").join(toks, "anchor").groupBy(key, "anchor").agg(F.array_sort(F.collect_set(doc)).alias("chunks"))
    best = F.min_by(F.struct("anchor", "chunks"), F.struct(-F.length("anchor"), F.col("anchor")))
    return hits.groupBy(key).agg(best.alias("b")).select(key, "b.anchor", "b.chunks")


def autolabel(questions: DataFrame, chunks: DataFrame, key: str = "id", answer: str = "answer", doc: str = "chunk_pos", text: str = "text") -> DataFrame:
    """``key, tier, matched, chunks``: VERBATIM, else ANCHOR, else ABSTAIN with nothing."""
    v = verbatim_labels(questions, chunks, key, answer, doc, text).select(key, F.col("span").alias("v"), F.col("chunks").alias("vc"))
    a = anchor_labels(questions, chunks, key, answer, doc, text).select(key, F.col("anchor").alias("a"), F.col("chunks").alias("ac"))
    j = questions.select(key).join(v, key, "left").join(a, key, "left")
    tier = F.when(F.col("v").isNotNull(), F.lit("VERBATIM")).when(F.col("a").isNotNull(), F.lit("ANCHOR")).otherwise(F.lit("ABSTAIN"))
    return j.select(key, tier.alias("tier"), F.coalesce("v", "a", F.lit("")).alias("matched"), F.coalesce("vc", "ac").alias("chunks"))


def labelled_only(labels: DataFrame) -> DataFrame:
    return labels.where("tier <> 'ABSTAIN'")


def answer_candidates(questions: DataFrame, chunks: DataFrame, n: int = 6, weak: bool = False, key: str = "id", answer: str = "answer", doc: str = "chunk_pos", text: str = "text") -> DataFrame:
    """``key, doc, overlap, place``: the ``n`` chunks that share most distinct tokens with the answer, ties to the larger id.

    Only chunks that share a token are ranked.  ``weak`` uses the tokens and stop words of labelling.
    """
    if weak:
        qt, ct, stop = F.split(T.norm_anchor(F.col(answer)), " "), F.split(T.norm_anchor(F.col(text)), " "), T.STOP_WORDS
    else:
        qt, ct, stop = T.words(F.col(answer)), T.words(F.col(text)), T.CANDIDATE_STOP_WORDS
    want = questions.select(key, F.explode(F.array_except(F.array_distinct(qt), F.array(*map(F.lit, stop)))).alias("tok")).where("tok <> ''")
    have = chunks.where(F.col(text).isNotNull()).select(doc, text, F.array_distinct(ct).alias("__w"))
    return overlap.most_shared(want, have, n, key, doc, text, "__w")


def label_review(questions: DataFrame, chunks: DataFrame, key: str = "id", answer: str = "answer", gold: str = "gold_chunks", span: str = "matched_span", doc: str = "chunk_pos", text: str = "text") -> DataFrame:
    """``key, why, best_other, n_other``: labels a person should look at.

    ``span_absent``: the claimed span is not in the gold chunks.  ``other_chunk``: without a claimed span, the
    gold chunks have none of the answer's distinctive words while another has two or more.
    """
    g = questions.select(key, F.explode(gold).alias(doc)).distinct()
    texts = chunks.where(F.col(text).isNotNull()).select(doc, T.norm_words(F.col(text)).alias("__t"))
    claimed = questions.where(F.length(span) > 0).select(key, T.norm_words(F.col(span)).alias("__s"))
    seen = claimed.join(g, key).join(texts, doc).groupBy(key).agg(F.max(F.col("__t").contains(F.col("__s"))).alias("ok"))
    has_gold = g.select(key).distinct()
    absent = claimed.join(has_gold, key, "left_semi").join(seen, key, "left").where(~F.coalesce("ok", F.lit(False))).select(key, F.lit("span_absent").alias("why"), F.lit(None).cast("long").alias("best_other"), F.lit(None).cast("long").alias("n_other"))
    have = chunks.where(F.col(text).isNotNull()).select(doc, text, F.array_distinct(T.words(F.col(text))).alias("__w"))
    n = chunks.agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * F.lit(REVIEW_DF_SHARE))).alias("most"))
    common = have.select(F.explode("__w").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where("df > most").select("tok")
    free = questions.where((F.coalesce(F.length(span), F.lit(0)) == 0)).join(has_gold, key, "left_semi")
    want = free.select(key, F.explode(F.array_distinct(T.words(F.col(answer)))).alias("tok")).where(F.length("tok") >= 4).join(common, "tok", "left_anti")
    # whose gold chunks have a word is settled by those chunks alone; of the rest, any best chunk is another
    own = g.join(want.groupBy(key).agg(F.collect_set("tok").alias("__a")), key).join(have, doc).where(F.arrays_overlap("__a", "__w")).select(key).distinct()
    best = overlap.most_shared(want.join(own, key, "left_anti"), have, 1, key, doc, text, "__w")
    other = best.where("overlap >= 2").select(key, F.lit("other_chunk").alias("why"), F.col(doc).cast("long").alias("best_other"), F.col("overlap").alias("n_other"))
    return absent.unionByName(other)


# What a probe that must be declined carries.
PROBE = {"stratum": "unanswerable", "answer": "NOT_IN_CORPUS", "label_status": "single_annotator_unverified"}


def abstention_probes(asked: DataFrame, chunks: DataFrame, origin: str, question: str = "question", why: str = "why_absent", telling: str = "telling", doc: str = "chunk_pos", text: str = "text") -> DataFrame:
    """Question records that no chunk answers: ``id, question, answer, stratum, gold_chunks`` (empty)``, origin, label_status, why_absent``.

    ``telling`` lists the words an answer would have to have; a question whose words all stand in one chunk is left out, since it may be
    answered there.  Null or empty lists prove nothing and are left out too.  Ids number the probes by question.
    """
    want = asked.where((F.size(telling) > 0) & F.col(question).isNotNull()).select(question, why, F.array_distinct(F.transform(telling, lambda w: F.lower(w))).alias("__w")).distinct()
    have = chunks.where(F.col(text).isNotNull()).select(doc, F.explode(F.array_distinct(T.words(F.col(text)))).alias("__t"))
    met = want.select(question, F.size("__w").alias("__n"), F.explode("__w").alias("__t")).join(have, "__t").groupBy(question, "__n", doc).agg(F.count(F.lit(1)).alias("k")).where("k = __n").select(question).distinct()
    kept = want.join(met, question, "left_anti")
    no = F.row_number().over(W.orderBy(question))  # probes are written by people: few
    return kept.select(F.format_string("U%02d", no).alias("id"), question, *[F.lit(v).alias(k) for k, v in PROBE.items()], F.array().cast("array<bigint>").alias("gold_chunks"), F.lit(origin).alias("origin"), why)


def pending(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


ships(__name__)
