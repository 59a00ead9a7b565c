"""Quality gates on extracted text, and gates on labels and corpora.

Predicates are Column expressions.  ``require_*`` functions trigger an action and raise; they are the only
ones that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T

# Thresholds and signatures the gates are defined by.
DIGIT_WALL = 0.35
DOT_SHARE = 0.30
DOT_LEADER = rf"(?U)(?:\.{T.BLANK}*){{4,}}"
TOC_LINE = rf"(?U)^{T.BLANK}*\d+(?:\.\d+)*{T.BLANK}+[^\s\x1c-\x1f][^|]*?{T.BLANK}+\d+{T.BLANK}*$"
PLACEHOLDER_HEADER = rf"(?U)\bcol\d+{T.BLANK}*:"
STRANDED_SUFFIX = rf"(?U):{T.BLANK}*(?:ted|ing|tion|ed|ly|ment|ness)\b"
TORN_DECIMAL = rf"(?U)\|{T.BLANK}*\.\d"


class GateError(RuntimeError):
    """A gate that must not fail did."""


def is_front_matter(text: Column) -> Column:
    """Tables of contents and the like: many bare dots, or half of the dot-leader lines shaped number, title, page."""
    toks = T.blank_split(text)
    dots = F.size(F.filter(toks, lambda t: t.rlike(r"^\.+$")))
    leaders = F.filter(F.split(text, "\n"), lambda l: l.rlike(DOT_LEADER))
    shaped = F.filter(leaders, lambda l: T.squeeze_ends(F.regexp_replace(l, DOT_LEADER, " ")).rlike(TOC_LINE))
    return (F.size(toks) > 0) & ((dots / F.greatest(F.lit(1), F.size(toks)) >= F.lit(DOT_SHARE)) | ((F.size(leaders) > 0) & (F.size(shaped) * 2 >= F.size(leaders))))


def gate_density(text: Column) -> Column:
    return F.when(is_front_matter(text), F.lit(0.0)).otherwise(T.digit_density(F.regexp_replace(text, DOT_LEADER, " ")))


def is_orphan_digit_wall(text: Column) -> Column:
    """Figures without any label."""
    return (gate_density(text) >= F.lit(DIGIT_WALL)) & ~text.contains(":") & ~text.contains("|")


def is_garbled(text: Column) -> Column:
    """Labels that are there and mean nothing."""
    return text.rlike(PLACEHOLDER_HEADER) | text.rlike(STRANDED_SUFFIX) | text.rlike(TORN_DECIMAL)


def has_ambiguous_headers(text: Column) -> Column:
    """Some row has the same header twice."""

    def repeated(line: Column) -> Column:
        parts = F.split(line, r"\|")
        heads = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), lambda s: s.contains(":")), lambda s: T.squeeze_ends(F.substring_index(s, ":", 1)))
        return line.contains("|") & (F.size(heads) >= 2) & (F.size(F.array_distinct(heads)) < F.size(heads))

    return F.exists(F.split(text, "\n"), repeated)


def flag(text: Column) -> Column:
    """The first gate that fires, in the order orphan, garbled, ambiguous; empty if none."""
    return F.when(is_orphan_digit_wall(text), F.lit("orphan")).when(is_garbled(text), F.lit("garbled")).when(has_ambiguous_headers(text), F.lit("ambiguous")).otherwise(F.lit(""))


def gate_report(blocks: DataFrame, doc: str = "doc", text: str = "text", kind: str = "kind") -> DataFrame:
    """Per document: blocks, tables, counts per gate, and whether it has no table at all."""
    t = F.col(text)
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return blocks.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_blocks"), n(F.col(kind) == "table").alias("n_tables"), n(is_front_matter(t)).alias("n_front_matter"),
        n(is_orphan_digit_wall(t)).alias("n_orphan"), n(is_garbled(t)).alias("n_garbled"), n(has_ambiguous_headers(t)).alias("n_ambiguous"),
    ).withColumn("no_tables", F.col("n_tables") == 0)


def gate_samples(blocks: DataFrame, doc: str = "doc", text: str = "text", order: str = "chunk_pos", n: int = 3, width: int = 95) -> DataFrame:
    """Up to ``n`` samples per document and gate, in order: a report's top list."""
    from pyspark.sql import Window as W

    t = F.col(text)
    f = blocks.withColumn("gate", flag(t)).where("gate <> ''")
    w = W.partitionBy(doc, "gate").orderBy(order)
    return f.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n).select(doc, "gate", "sample_no", order, F.substring(t, 1, width).alias("sample"))


def gold_smear(questions: DataFrame, n_chunks: int, gold: str = "gold_chunks") -> DataFrame:
    """Questions whose gold list is suspiciously long: a warning, not an error."""
    return questions.where(F.size(gold) > max(3, n_chunks // 5))


def gold_missing(questions: DataFrame, chunks: DataFrame, key: str = "id", gold: str = "gold_chunks", pos: str = "chunk_pos") -> DataFrame:
    """``key, gold``: gold ids that no chunk has."""
    return questions.select(key, F.explode(gold).alias("gold")).distinct().join(chunks.select(F.col(pos).alias("gold")), "gold", "left_anti").select(key, "gold")


def require_empty(bad: DataFrame, what: str) -> None:
    rows = bad.take(3)
    if rows:
        raise GateError(f"{what}: {rows}")


def require_fingerprint(got: str, stamped: str | None, what: str = "corpus") -> None:
    """Fatal on a mismatch; without a stamp there is nothing to check."""
    if stamped and got != stamped:
        raise GateError(f"{what}: fingerprint {got}, stamped {stamped}")


def require_same_corpus(fingerprint: str, stamped: str | None, content: bytes, reference: bytes | None) -> str:
    """Two ways to show that nothing drifted: the stamp, else byte identity with a reference; neither is an error."""
    if stamped:
        require_fingerprint(fingerprint, stamped)
        return "fingerprint"
    if reference is not None:
        if content != reference:
            raise GateError("corpus differs from the reference file")
        return "bytes"
    raise GateError("neither a stamp nor a reference file to check against")


def require_unique(df: DataFrame, key: str, what: str) -> None:
    require_empty(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{what}: repeated {key}")
