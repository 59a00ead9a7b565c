import random
import re

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import chunking, gates, tables

SECTION = re.compile(r"(?<![\d.])(\d{1,2})\.\s+([A-Z][a-z]+(?:\s+[A-Za-z]+){0,5}?)(?=\s+[A-Z]|\s*$)")


def segments(stream, title):
    """What lies between the markers of a left-to-right search."""
    marks = list(SECTION.finditer(stream))
    edges = [*(m.start() for m in marks), len(stream)]
    named = ((m.group().strip(), stream[m.end() : stop].strip()) for m, stop in zip(marks, edges[1:]))
    return [part for part in [(title, stream[: edges[0]]), *named] if part[1].strip()]


def test_section_cut_equals_sequential_matching(spark):
    rng = random.Random(7)
    parts = ["1. Introduction ", "3.5 kg ", "12. Returns and refunds ", "41.\u00a0The\u00a0trade\u00a0school ", "2.\u2003Scope", "Goods are sold. ", "a ", "4. Fees", " We pay ", "x. Y ", " "]
    streams = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(streams)), "doc int, stream string")
    got = {}
    for r in chunking.sections(d, title=F.lit("doc")).orderBy("doc", "seg_no").collect():
        got.setdefault(r.doc, []).append((r.heading, r.body))
    wrong = [(s, segments(s, "doc"), got.get(i, [])) for i, s in enumerate(streams) if segments(s, "doc") != got.get(i, [])]
    assert wrong == []


def test_packing_carries_the_heading_and_respects_the_budget(spark):
    d = spark.createDataFrame([("H", "One two three. Four five six. Seven eight nine.")], "heading string, body string")
    r = chunking.pack_sentences(d, budget=10).first().chunks
    assert r == ["H\nOne two three. Four five six.", "H\nSeven eight nine."] and all(len(x) / 3.5 < 10 for x in r)
    big = chunking.pack_sentences(d, budget=3).select(F.explode("chunks").alias("text")).withColumn("n_tokens", T.token_estimate(F.col("text")))
    with pytest.raises(chunking.OverBudget):
        chunking.over_budget(big, 3, strict=True)


def test_stream_offsets_and_pages(spark):
    lines = spark.createDataFrame([("d", 1, 0, " alpha "), ("d", 1, 1, "Page 1 of 2"), ("d", 2, 0, "beta"), ("d", 2, 1, "")], "doc string, page int, line_no int, line string")
    clean = chunking.clean_lines(lines)
    assert chunking.document_stream(clean).first().stream == "alpha beta"
    starts = chunking.line_offsets(clean)
    pts = spark.createDataFrame([("d", 0), ("d", 5), ("d", 6), ("d", 99)], "doc string, at bigint")
    assert {r.at: r.page for r in chunking.page_of_offset(pts, starts).collect()} == {0: 1, 5: 1, 6: 2, 99: 2}


def test_offsets_of_absent_bodies(spark):
    s = spark.createDataFrame([("d", "x alpha beta")], "doc string, stream string")
    c = spark.createDataFrame([("d", "H\nalpha"), ("d", "H\nzeta")], "doc string, text string")
    got = {r.text: (r.char_start, r.char_end) for r in chunking.body_offsets(c, s).collect()}
    assert got == {"H\nalpha": (2, 7), "H\nzeta": (-1, -1)}


def test_fingerprint_keeps_trailing_blanks(spark):
    import hashlib

    rows = [(1, "b "), (0, "a")]
    got = chunking.corpus_fingerprint(spark.createDataFrame(rows, "chunk_pos bigint, text string")).first().fingerprint
    assert got == hashlib.sha256("0\x00a\n1\x00b ".encode()).hexdigest()[:16]


def tab(spark, rows, f):
    return spark.createDataFrame([(rows,)], "r array<array<string>>").select(f(F.col("r")).alias("x")).first().x


STACK = [["", "May 2023", "May 2022"], ["", "counted", "counted"], ["", "pieces", "pieces"], ["Lamps", "4,310", "3,977"], [None, "", ""], ["Bags", "", "7"]]


def test_header_stack_and_serialisation(spark):
    assert tuple(tab(spark, STACK, tables.header_span)) == (0, 3)
    text = tab(spark, STACK, tables.serialise)
    assert text == "Lamps | May 2023 counted pieces: 4,310 | May 2022 counted pieces: 3,977\nBags | May 2022 counted pieces: 7"
    assert not tab(spark, STACK, lambda r: gates.has_ambiguous_headers(tables.serialise(r)))


def test_labelled_stub_and_no_header(spark):
    assert tab(spark, [["Crates", "north", "south"], ["Lamps", "3", "4"]], tables.serialise) == "Lamps | north: 3 | south: 4"
    assert tab(spark, [["a", "1"], ["b", "2"]], tables.serialise) == ""
    assert tab(spark, [["", "north"], ["a", "1"]], tables.serialise) is not None


def test_real_tables(spark):
    assert tab(spark, STACK, tables.is_real_table) and not tab(spark, [["a", ""]], tables.is_real_table)
    assert not tab(spark, [["a", "", "", ""], ["", "", "", ""]], tables.is_real_table)


FIRE = {
    gates.is_orphan_digit_wall: ["Lamps 4,310 3,977 8.4% 1,120 1,004\nBags 2,001 1,880 6.4% 512 498"],
    gates.is_garbled: ["Crate LMP | col2: 14.5 kg", "weights roun 71.5 | .3 kg", "weights roun: ing"],
    gates.has_ambiguous_headers: ["Depot | kg: 1,200 | kg: 1,031 | kg: 1,086"],
}
SILENT = {
    gates.is_orphan_digit_wall: ["Lamps | 2023: 4,310 | 2022: 3,977", "2.3 Returns . . . . . . . . 14\n2.4 Fees . . . . . . . 15", "Sales grew by 8.4% in the second week."],
    gates.is_garbled: ["Lamps | 2023: 4,310 | 2022: 3,977", "Bulb XR/7 | Voltage: 12.5 V | Length: 20cm"],
    gates.has_ambiguous_headers: ["Depot | May kg: 1 | June kg: 2", "no table: at: all"],
}


@pytest.mark.parametrize("gate", list(FIRE), ids=lambda g: g.__name__)
def test_gates_fire_and_stay_silent(spark, gate):
    for texts, want in ((FIRE[gate], True), (SILENT[gate], False)):
        for t in texts:
            assert spark.createDataFrame([(t,)], "t string").select(gate(F.col("t")).alias("g")).first().g is want, t


def test_fatal_gates(spark):
    with pytest.raises(gates.GateError):
        gates.require_fingerprint("a", "b")
    gates.require_fingerprint("a", "")
    assert gates.require_same_corpus("a", None, b"x", b"x") == "bytes"
    with pytest.raises(gates.GateError):
        gates.require_same_corpus("a", None, b"x", b"y")
    with pytest.raises(gates.GateError):
        gates.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k", "rows")
