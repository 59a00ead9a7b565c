"""Grading answers: a deterministic layer, a judge's layer, and how they agree; prompts and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from docweft.functions import text as T

# The sentinel answers are checked for, the label of general knowledge, and the verdict cuts.
SENTINEL = "NOT_IN_DOCUMENTS"
GENERAL_KNOWLEDGE = "[GENERAL KNOWLEDGE"
PASS_RATIO, WEAK_RATIO = 0.5, 0.3
LAUNDERED_EXTRA = 25

#: Prompts are data: what is asked of a model, by name.  ``{context}`` and ``{question}`` are filled in.
PROMPTS = {
    "grounded": ("Answer from the numbered passages only. Quote figures, names and dates as they stand. If no passage holds anything that answers the question, reply with NOT_IN_DOCUMENTS and nothing else.",
                 "Passages:\n{context}\n\nQuestion: {question}\n\nAnswer from the passages."),
    "judge": ('Say whether the answer is supported by the passages. Reply with one JSON object: {"verdict": "FAITHFUL|UNFAITHFUL|CORRECT_ABSTENTION|WRONG_ABSTENTION", "evidence": "...", "reason": "..."}.',
              "Passages:\n{context}\n\nQuestion: {question}\n\nAnswer: {answer}"),
}
JUDGE_SCHEMA = t.StructType([t.StructField(c, t.StringType()) for c in ("verdict", "evidence", "reason")])


def abstained(answer: Column) -> Column:
    """The sentinel stands anywhere, in any case."""
    return F.lower(answer).contains(SENTINEL.lower())


def abstained_prefix(answer: Column) -> Column:
    """The trimmed answer begins with the sentinel."""
    return T.squeeze_ends(answer).startswith(SENTINEL)


def laundered(answer: Column) -> Column:
    """The sentinel is there, and more than a few words besides."""
    return abstained(answer) & (F.length(answer) - len(SENTINEL) > LAUNDERED_EXTRA)


def _graded(text: Column) -> Column:
    return F.array_distinct(T.all_matches(T.norm_spaces(text), T.GRADED_TOKEN))


def layer_a(answers: DataFrame, chunks: DataFrame, key: str = "answer_id", answer: str = "answer", gold: str = "gold_chunks", doc: str = "chunk_pos", text: str = "text") -> DataFrame:
    """``answers`` with ``a_ratio, a_verdict, a_abstained, a_gk_labelled``.

    Without gold the right thing is to abstain.  With gold, abstaining fails; else the share of the answer's distinctive
    tokens that stand in its gold chunks decides: PASS from 0.5, WEAK from 0.3.  Gold chunks are joined
    by token, so their texts are not gathered per answer.  A null answer counts as an empty one.
    """
    a = answers.withColumn("__a", F.coalesce(F.col(answer), F.lit("")))
    toks = F.filter(_graded(F.col("__a")), lambda x: (F.length(x) > 3) | x.rlike("[0-9@]"))
    own = a.select(key, F.explode(F.coalesce(F.col(gold), F.array().cast("array<bigint>"))).alias(doc)).distinct()
    want = a.select(key, F.explode(toks).alias("tok"))
    needed = own.join(chunks.select(doc, F.explode(_graded(F.col(text))).alias("tok")), doc).select(key, "tok").distinct()
    met = want.join(needed, [key, "tok"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("__met"))
    ratio = F.coalesce("__met", F.lit(0)) / F.greatest(F.lit(1), F.size(toks))
    out = a.join(met, key, "left").withColumn("a_ratio", ratio).withColumn("a_abstained", abstained(F.col("__a")))
    none = F.size(F.coalesce(F.col(gold), F.array().cast("array<bigint>"))) == 0
    verdict = (F.when(none, F.when(F.col("a_abstained"), F.lit("PASS")).otherwise(F.lit("FAIL"))).when(F.col("a_abstained"), F.lit("FAIL"))
               .when(F.col("a_ratio") >= F.lit(PASS_RATIO), F.lit("PASS")).when(F.col("a_ratio") >= F.lit(WEAK_RATIO), F.lit("WEAK")).otherwise(F.lit("FAIL")))
    return (out.withColumn("a_verdict", verdict).withColumn("a_gk_labelled", none & F.lower("__a").contains(GENERAL_KNOWLEDGE.lower()))
            .withColumn("a_ratio", F.when(none | F.col("a_abstained"), F.lit(None)).otherwise(F.col("a_ratio"))).drop("__a", "__met"))


def parse_judge(raw: Column) -> Column:
    """The outermost braces of a judge's reply as ``struct(verdict, evidence, reason)``; PARSE_ERROR with the reply's start if there is none or it is no JSON."""
    got = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")), JUDGE_SCHEMA, {"mode": "PERMISSIVE"})
    bad = F.struct(F.lit("PARSE_ERROR").alias("verdict"), F.lit("").alias("evidence"), F.substring(raw, 1, 120).alias("reason"))
    return F.when(got.isNull() | (got["verdict"].isNull() & got["evidence"].isNull() & got["reason"].isNull()), bad).otherwise(got)


def judge(answers: DataFrame, make_client, key: str = "answer_id", context: str = "context", question: str = "question", answer: str = "answer") -> DataFrame:
    """``key, b_verdict, b_evidence, b_reason``: a model's verdict on every answer, asked on the executors; unreadable replies are PARSE_ERROR."""
    from docweft.sources.models import complete_all

    system, user = PROMPTS["judge"]
    asked = answers.select(key, F.lit(system).alias("system"), fill(user, context=F.col(context), question=F.col(question), answer=F.col(answer)).alias("user"))
    got = parse_judge(F.col("reply"))
    return complete_all(asked, make_client, key).select(key, got["verdict"].alias("b_verdict"), got["evidence"].alias("b_evidence"), got["reason"].alias("b_reason"))


def a_binary(verdict: Column) -> Column:
    return F.when(verdict == "PASS", F.lit("PASS")).when(verdict == "WEAK", F.lit("REVIEW")).otherwise(F.lit("FAIL"))


def b_binary(verdict: Column) -> Column:
    return (F.when(verdict.isin("FAITHFUL", "CORRECT_ABSTENTION"), F.lit("PASS")).when(verdict.isin("UNFAITHFUL", "WRONG_ABSTENTION"), F.lit("FAIL")).otherwise(F.lit("REVIEW")))


def reconcile(verdicts: DataFrame, gold: str = "gold_chunks") -> DataFrame:
    """Adds ``a_bin, b_bin, agree, needs_review``: people see disagreements, weak and unreadable verdicts, and all unanswerable questions."""
    none = F.size(F.coalesce(F.col(gold), F.array().cast("array<bigint>"))) == 0
    v = verdicts.withColumn("a_bin", a_binary(F.col("a_verdict"))).withColumn("b_bin", b_binary(F.coalesce("b_verdict", F.lit(""))))
    v = v.withColumn("agree", F.col("a_bin") == F.col("b_bin"))
    return v.withColumn("needs_review", ~F.col("agree") | (F.col("a_bin") == "REVIEW") | (F.col("b_bin") == "REVIEW") | none | (F.coalesce("b_verdict", F.lit("")) == "PARSE_ERROR"))


def agreement_report(v: DataFrame, gold: str = "gold_chunks") -> DataFrame:
    some = F.size(F.coalesce(F.col(gold), F.array().cast("array<bigint>"))) > 0
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    r = lambda c: F.round(F.avg(F.when(some, c.cast("double"))), 6)
    return v.agg(F.count(F.lit(1)).alias("n"), n(some).alias("n_answerable"), F.round(F.avg(F.col("agree").cast("double")), 6).alias("agreement"), n(F.col("needs_review")).alias("n_review"),
                 *[r(F.col("a_bin") == x).alias(f"a_{x.lower()}") for x in ("PASS", "FAIL", "REVIEW")], n(~some & (F.col("a_verdict") == "PASS")).alias("probes_right"))


def run_summary(v: DataFrame, run: tuple[str, ...] = ("prompt_version",), answer: str = "answer", gold: str = "gold_chunks") -> DataFrame:
    """Per run (and stratum, if named): answerable answers and passes, abstentions, laundered ones, labelled knowledge, probes."""
    some = F.size(F.coalesce(F.col(gold), F.array().cast("array<bigint>"))) > 0
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a = F.coalesce(F.col(answer), F.lit(""))
    passed = n(some & (F.col("a_verdict") == "PASS"))
    return v.groupBy(*run).agg(n(some).alias("answerable"), passed.alias("passed"), F.round(F.lit(100.0) * passed / F.greatest(F.lit(1), n(some)), 1).alias("passed_pct"),
                               n(some & F.col("a_abstained")).alias("wrong_abstentions"), n(laundered(a)).alias("laundered"), n(F.lower(a).contains(GENERAL_KNOWLEDGE.lower())).alias("gk_labelled"),
                               n(~some).alias("probes"), n(~some & (F.col("a_verdict") == "PASS")).alias("probes_right"))


def churn(v: DataFrame, runs: list[str], run: str = "prompt_version", key: str = "id") -> DataFrame:
    """``key`` and one column per run with its verdict, for questions whose verdict differs between runs."""
    wide = v.groupBy(key).pivot(run, runs).agg(F.min("a_verdict"))
    return wide.where(F.size(F.array_distinct(F.array(*runs))) > 1)


def human_tally(items: DataFrame, a: str = "a_verdict", human: str = "human_verdict") -> DataFrame:
    """Per Layer-A verdict: the people's verdicts and the share of CORRECT, null where there is none."""
    kinds = ["CORRECT", "UNGROUNDED", "WRONG", "LABEL ISSUE"]
    t_ = items.groupBy(a).agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(human) == k).cast("long")).alias(k.lower().replace(" ", "_")) for k in kinds])
    return t_.withColumn("precision", F.round(F.col("correct") / F.nullif(F.col("n"), F.lit(0)), 6))


def contexts(hits: DataFrame, query: str = "query_id", rank: str = "rank", text: str = "text", number: str | None = None) -> DataFrame:
    """``query, context``: ``[i] text`` blocks in rank order, numbered from 1, or by the column ``number``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"), (F.col(number) if number else F.col(rank)).alias("n"))))
    block = F.transform(rows, lambda x, i: F.concat(F.lit("["), (x["n"] if number else i + 1).cast("string"), F.lit("] "), F.coalesce(x["t"], F.lit(""))))
    return hits.groupBy(query).agg(F.array_join(block, "\n\n").alias("context"))


def fill(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` places filled from columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(columns[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def tokens_per_second(count: Column, ns: Column) -> Column:
    """Null where the count or the time is missing or zero."""
    return F.round(F.nullif(count, F.lit(0)) / (F.nullif(ns, F.lit(0)) / F.lit(1e9)), 2)
