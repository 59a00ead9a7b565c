"""From lines to chunks: document stream, section cut, sentence packing, offsets, pages, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.functions import text as T

BUDGET = 400
# Fixed value: what counts as an inline section marker, a number of one or two digits and a capitalised title.
SECTION = rf"(?U)(?<![\d.])(\d{{1,2}})\.{T.BLANK}+([A-Z][a-z]+(?:{T.BLANK}+[A-Za-z]+){{0,5}}?)(?={T.BLANK}+[A-Z]|{T.BLANK}*$)"
SECTION_CUT = rf"(?={SECTION})"


def clean_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines trimmed, without empty ones and page furniture."""
    return lines.withColumn(line, T.squeeze_ends(F.col(line))).where((F.length(line) > 0) & ~T.is_furniture(F.col(line)))


def lines_of(docs: DataFrame, doc: str, text: str, page: Column | None = None) -> DataFrame:
    """``doc, page, line_no, line`` of texts with line breaks; everything is page 1 unless ``page`` says otherwise."""
    return docs.select(doc, (page if page is not None else F.lit(1)).alias("page"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def document_stream(lines: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("page", "line_no"), line: str = "line") -> DataFrame:
    """``doc, stream``: a document's lines in order, joined by blanks.  A group is one document."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line)))
    return lines.groupBy(doc).agg(F.array_join(F.transform(rows, lambda r: r[line]), " ").alias("stream"))


def line_offsets(lines: DataFrame, doc: str = "doc", order: tuple[str, ...] = ("page", "line_no"), line: str = "line") -> DataFrame:
    """``lines`` with ``line_start``: where a line begins in the document stream."""
    w = W.partitionBy(doc).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("line_start", F.coalesce(F.sum(F.length(line) + 1).over(w), F.lit(0)))


def page_of_offset(points: DataFrame, lines: DataFrame, doc: str = "doc", at: str = "at") -> DataFrame:
    """``points`` with ``page``: the page of the last line that begins at or before the offset, an as-of lookup.

    Points and line starts are merged in one window per document, so no row meets every line.
    """
    marks = lines.select(doc, F.col("line_start").alias("__at"), F.lit(0).alias("__kind"), F.col("page").alias("__page"), F.lit(None).cast(points.schema[at].dataType).alias(at))
    probes = points.select(doc, F.col(at).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("int").alias("__page"), at)
    w = W.partitionBy(doc).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    both = marks.withColumn("__page", F.col("__page").cast("int")).unionByName(probes).withColumn("page", F.last("__page", True).over(w))
    first = W.partitionBy(doc).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    both = both.withColumn("page", F.coalesce("page", F.first("__page", True).over(first)))
    return both.where("__kind = 1").select(doc, at, "page").distinct()


def sections(streams: DataFrame, doc: str = "doc", stream: str = "stream", title: Column | None = None) -> DataFrame:
    """``doc, seg_no, heading, body, seg_start``: the stream cut before every section marker.

    Text before the first marker gets ``title`` (the document's name) as heading and keeps its ends; other bodies are
    trimmed.  A marker at a segment's end can only be told from the whole stream, so the first segment's
    heading is read there.
    """
    title = title if title is not None else F.regexp_replace(F.regexp_replace(F.col(doc).cast("string"), r"\.[^.]*$", ""), "_", " ")
    cut = streams.select(doc, stream, title.alias("__title"), F.split(stream, SECTION_CUT).alias("__segs"))
    lengths = F.transform(F.col("__segs"), lambda s: F.length(s))
    starts = F.transform(F.col("__segs"), lambda s, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    rows = cut.select(doc, stream, "__title", F.posexplode(F.arrays_zip(F.col("__segs").alias("seg"), starts.alias("start"))).alias("seg_no", "__z"))
    seg = F.col("__z.seg")
    own = F.when(F.col("seg_no") == 0, F.regexp_extract(F.col(stream), f"^{SECTION}", 0)).otherwise(F.regexp_extract(F.concat(seg, F.lit(" X")), f"^{SECTION}", 0))
    marked = F.length(own) > 0
    return rows.select(
        doc, "seg_no", F.when(marked, T.squeeze_ends(own)).otherwise(F.col("__title")).alias("heading"),
        F.when(marked, T.squeeze_ends(F.substring(seg, F.length(own) + 1, F.length(seg)))).otherwise(seg).alias("body"),
        F.col("__z.start").cast("int").alias("seg_start"),
    ).where(F.length(T.squeeze_ends(F.col("body"))) > 0)


def pack_sentences(segments: DataFrame, head: str = "heading", body: str = "body", budget: int = BUDGET, out: str = "chunks") -> DataFrame:
    """``segments`` with an array of chunk texts: the heading, a line break, and as many sentences as the budget holds.

    A fold over the sentences in one expression; a sentence that alone exceeds the budget becomes a chunk of its own.
    """
    sents = F.filter(T.sentences(F.col(body)), lambda s: F.length(s) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(acc: Column, sent: Column) -> Column:
        longer = F.when(F.length(acc["buf"]) > 0, F.concat(acc["buf"], F.lit(" "), sent)).otherwise(sent)
        over = (F.length(acc["buf"]) > 0) & (T.token_estimate(F.concat(F.col(head), F.lit("\n"), longer)) > budget)
        return F.struct(F.when(over, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"), F.when(over, sent).otherwise(longer).alias("buf"))

    packed = F.aggregate(sents, start, add, lambda a: F.when(F.length(a["buf"]) > 0, F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]))
    return segments.withColumn(out, F.transform(packed, lambda b: F.concat(F.col(head), F.lit("\n"), b)))


def chunk_texts(docs: DataFrame, doc: str = "doc", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """``doc, ordinal, heading, text, n_tokens``: all steps, from texts with line breaks to chunks."""
    streams = document_stream(clean_lines(lines_of(docs, doc, text)), doc)
    packed = pack_sentences(sections(streams, doc), budget=budget)
    rows = packed.select(doc, "seg_no", "heading", F.posexplode("chunks").alias("in_seg", "text"))
    w = W.partitionBy(doc).orderBy("seg_no", "in_seg")
    return rows.withColumn("ordinal", F.row_number().over(w) - 1).select(doc, "ordinal", "heading", "text", T.token_estimate(F.col("text")).alias("n_tokens"))


class OverBudget(RuntimeError):
    """A chunk exceeds the token budget."""


def over_budget(chunks: DataFrame, budget: int = BUDGET, strict: bool = False, n_tokens: str = "n_tokens") -> DataFrame:
    """Chunks over the budget, for a quarantine table; ``strict`` raises at the first."""
    bad = chunks.where(F.col(n_tokens) > budget)
    if strict and (row := bad.first()):
        raise OverBudget(f"{row[n_tokens]} tokens, budget {budget}")
    return bad


def body_offsets(chunks: DataFrame, streams: DataFrame, doc: str = "doc", text: str = "text", stream: str = "stream") -> DataFrame:
    """``chunks`` with ``char_start`` and ``char_end`` of their body's first occurrence in the stream; -1 where it is absent."""
    body = T.heading_and_body(F.col(text))[1]
    at = F.instr(F.col(stream), body)
    j = chunks.join(streams.select(doc, stream), doc).withColumn("char_start", (at - 1).cast("int"))
    return j.withColumn("char_end", F.when(F.col("char_start") >= 0, F.col("char_start") + F.length(body)).otherwise(F.lit(-1))).drop(stream)


def corpus_fingerprint(chunks: DataFrame, pos: str = "chunk_pos", text: str = "text") -> DataFrame:
    """One row: the first 16 digits of the hash over all ``position, text`` pairs in order.

    This value is the one stamped in existing dumps; it needs all texts in one place, so it
    suits corpora that fit there.  ``tree_fingerprint`` has no such limit.
    """
    rows = F.array_sort(F.collect_list(F.struct(pos, text)))
    joined = F.array_join(F.transform(rows, lambda r: F.concat(r[pos].cast("string"), F.lit("\x00"), r[text])), "\n")
    return chunks.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"), F.count(F.lit(1)).alias("n_chunks"))


def tree_fingerprint(chunks: DataFrame, pos: str = "chunk_pos", text: str = "text", fan: int = 65536) -> DataFrame:
    """One row: a two-level hash, over runs of positions and then over the runs; for corpora of any size."""
    leaf = F.sha2(F.concat(F.col(pos).cast("string"), F.lit("\x00"), F.coalesce(F.col(text), F.lit("\x01"))), 256)
    w = chunks.select(F.floor(F.col(pos) / F.lit(fan)).alias("run"), F.struct(F.col(pos).alias("p"), leaf.alias("h")).alias("s"))
    runs = w.groupBy("run").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["h"]), "\n"), 256).alias("h"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "h"))), lambda s: s["h"]), "\n")
    return runs.agg(F.substring(F.sha2(top, 256), 1, 16).alias("tree_fingerprint"))


def chunk_metrics(chunks: DataFrame, doc: str = "doc", kind: str = "kind", n_tokens: str = "n_tokens") -> DataFrame:
    """Counts over the whole corpus, by kind and by document, told apart by ``scope``."""
    m = [F.count(F.lit(1)).alias("n_chunks"), F.countDistinct(doc).alias("n_docs"), F.max(n_tokens).alias("max_tokens"), F.floor(F.sum(n_tokens) / F.count(n_tokens)).alias("mean_tokens")]
    cols = ["scope", "name", "n_chunks", "n_docs", "max_tokens", "mean_tokens"]
    whole = chunks.agg(*m).withColumns({"scope": F.lit("corpus"), "name": F.lit("all")})
    by = [chunks.groupBy(F.col(c).alias("name")).agg(*m).withColumn("scope", F.lit(s)) for c, s in ((kind, "kind"), (doc, "doc"))]
    return whole.select(*cols).unionByName(by[0].select(*cols)).unionByName(by[1].select(*cols))


def stable_ids(chunks: DataFrame, sha256: str = "sha256", ordinal: str = "ordinal") -> DataFrame:
    return chunks.withColumn("chunk_id", T.chunk_id(F.col(sha256), F.col(ordinal)))
