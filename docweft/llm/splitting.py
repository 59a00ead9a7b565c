"""Splitting oversized texts at natural boundaries by recursive bisection, then attaching overlaps.

A text over the limit is cut at the strongest boundary near its middle; halves that still
exceed the limit less the overlap are cut again.  Each piece but the first then gets the end
of the one before in front of it.  Boundaries, strongest first: blank line, line break, white
space after ``.``, ``!`` or ``?``.  Only where a part that has to be cut has none of these is it cut
elsewhere, at white space if there is any.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm._util import ships

LIMIT, OVERLAP = 400, 40
CHARS_PER_TOKEN = 3.5
#: Share of a part around its middle in which the strongest boundary is looked for first.
NEAR = 0.5

NATURAL = re.compile(r"\n[^\S\n]*\n\s*|\n\s*|(?<=[.!?])\s+")
#: A single boundary: a line break, or white space right after a closing mark.
BOUNDARY = re.compile(r"\n|(?<=[.!?])\s")
PIECES = "array<struct<piece_no:int,char_start:int,char_end:int,core_start:int,n_tokens:int,cut:string,cut_kind:string>>"


def token_estimate(chars: Column) -> Column:
    return (F.floor(chars / F.lit(CHARS_PER_TOKEN)) + 1).cast("int")


def tokens_of(chars: int) -> int:
    return int(chars / CHARS_PER_TOKEN) + 1


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions at which a piece may begin, ascending, and their strengths: 3 after a blank line, 2 after a line break, 1 after
    a sentence's end, 0 elsewhere beside a boundary, as before a line break."""
    best: dict[int, int] = {}
    for m in BOUNDARY.finditer(text):
        best[m.start()] = best[m.end()] = 0
    for m in NATURAL.finditer(text):
        gap = m.group()
        best[m.end()] = 3 if gap.count("\n") > 1 else 2 if "\n" in gap else 1
    best.pop(0, None)
    best.pop(len(text), None)
    at = sorted(best)
    return at, [best[i] for i in at]


def longest_stretch(text: str) -> int:
    """Characters of the longest stretch without a line break or white space after ``.``, ``!`` or ``?``."""
    return max(map(len, re.split(r"\n|(?<=[.!?])\s", text)))


def bisect_cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Ascending cut positions and what each is: ``natural``; ``forced``, inside a stretch over the limit that has no natural
    boundary; or ``room``, inside such a stretch within the limit, to make room for the overlap.  No part between cuts has more than ``limit - overlap`` tokens."""
    at, strength = boundaries(text)
    goal, most = limit - overlap, _chars_within(limit)
    cuts, parts = [], [(0, len(text))]
    forced: set[int] = set()  # where parts of a stretch over the limit begin
    while parts:
        a, b = parts.pop()
        if tokens_of(b - a) <= goal or b - a < 2:
            continue
        lo, hi, middle = bisect_right(at, a), bisect_left(at, b), (a + b) / 2
        if lo < hi:
            reach = (b - a) * NEAR / 2
            near = range(bisect_left(at, middle - reach, lo, hi), bisect_right(at, middle + reach, lo, hi))
            if near:
                cut = at[max(near, key=lambda i: (strength[i], -abs(at[i] - middle)))]
            else:
                cut = at[min(range(max(lo, bisect_left(at, middle, lo, hi) - 1), min(hi, bisect_left(at, middle, lo, hi) + 1)), key=lambda i: abs(at[i] - middle))]
            kind = "natural"
        else:
            cut = _inside(text, a, b)
            kind = "forced" if b - a > most or a in forced else "room"
            if kind == "forced":
                forced |= {a, cut}
        cuts.append((cut, kind))
        parts += [(a, cut), (cut, b)]
    return sorted(cuts)


def _chars_within(limit: int) -> int:
    n = int(limit * CHARS_PER_TOKEN) + 2
    while n > 0 and tokens_of(n) > limit:
        n -= 1
    return n


def _inside(text: str, a: int, b: int) -> int:
    """White space nearest the middle of a part without natural boundaries, within its middle half; else the middle itself."""
    middle, reach = (a + b) // 2, max(1, (b - a) // 4)
    for d in range(reach):
        for i in (middle + d, middle - d):
            if a < i < b and text[i - 1].isspace() and not text[i].isspace():
                return i
    return middle


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """Pieces of one text: its own part from ``core_start`` on, the overlap before it from ``char_start`` on.

    The overlap is the last ``overlap`` tokens of the piece before, begun at white space where there is some near, and
    shorter only where that piece is.  ``cut`` says what the cut before a piece is, ``whole`` for the first; ``cut_kind`` is
    ``forced`` for all pieces of a text with a forced cut, else ``natural``, or ``whole`` for a text without cuts.
    """
    cuts = bisect_cuts(text, limit, overlap)
    starts = [0, *(c for c, _ in cuts)]
    kind = "whole" if not cuts else "forced" if any(k == "forced" for _, k in cuts) else "natural"
    out: list[dict] = []
    back = _chars_within(overlap)
    for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
        begin = a
        if n:
            begin = max(out[-1]["char_start"], a - back)
            for i in range(begin, min(begin + back // 4, a)):
                if i == 0 or text[i - 1].isspace():
                    begin = i
                    break
            while tokens_of(b - begin) > limit:
                begin += 1
        out.append({"piece_no": n, "char_start": begin, "char_end": b, "core_start": a, "n_tokens": tokens_of(b - begin), "cut": cuts[n - 1][1] if n else "whole", "cut_kind": kind})
    return out


def _splitter(limit: int, overlap: int):
    kind = pa.list_(pa.struct([("piece_no", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("core_start", pa.int32()), ("n_tokens", pa.int32()), ("cut", pa.string()), ("cut_kind", pa.string())]))

    def run(texts):
        return pa.array([None if t is None else split_text(t, limit, overlap) for t in texts.to_pylist()], type=kind)

    return run


def split_oversized(items: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """A row per piece of every item over ``limit`` tokens, with the item's other columns.

    New columns: ``piece_no`` from 0, ``char_start``, ``char_end`` (code points, end exclusive),
    ``core_start``, ``n_tokens``, ``cut`` (the cut before the piece), ``cut_kind`` (``natural``, or ``forced`` if a
    stretch without natural boundary exceeds the limit) and ``piece``.  Items within the limit, empty and null texts give no rows
    here.  An input column with one of these names is replaced.  Rows are not made distinct: repeated rows
    give repeated pieces.  Only oversized texts reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    new = ["piece_no", "char_start", "char_end", "core_start", "n_tokens", "cut", "cut_kind", "piece"]
    keep = [c for c in items.columns if c not in new]
    cut = F.arrow_udf(_splitter(limit, overlap), PIECES)
    big = items.where(token_estimate(F.length(text)) > limit).select(*keep, F.explode(cut(F.col(text))).alias("__p"))
    return (big.select(*keep, *[F.col(f"__p.{c}").alias(c) for c in new[:-1]])
            .withColumn("piece", F.substring(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))))


ships(__name__)
