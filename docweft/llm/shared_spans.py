"""Long spans that stand verbatim in more than one record, by difference-cover anchors.

A difference cover D of period p has, for any two positions i and j, a shift d < p with both
(i + d) mod p and (j + d) mod p in D.  So if two texts agree over ``length`` characters from i
and j on, they agree over a window of ``length - p + 1`` characters that begins at a cover
position in both.  Only those windows are hashed, about one position in nine; a window hash
that occurs in two texts marks where a long match can be.  There, and only there, every window
of the full length is compared, by a hash of 95 bits, which extends the anchors to the exact
spans without forming pairs of records.

Texts are told apart by a 64-bit hash, their class.  Hashes are made once and shuffled once.  A hash that many
texts have is no task's burden: a block of texts settles for itself which of its hashes are shared, and
sends one row of each on to the others; its other rows are spread by class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.llm._util import ships
from docweft.operators.skew import join_stats
from docweft.session import Kept

LENGTH = 200
#: The longer the period, the fewer positions are hashed and the shorter the window that anchors a match.
PERIOD = 91
#: Covers that are as small as can be (every difference but 0 once), by period; others are made greedily.
PERFECT = {13: (0, 1, 3, 9), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}


@Kept
def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of residues whose pairwise differences give every residue."""
    if period in PERFECT:
        return PERFECT[period]
    cover, missing = [0], set(range(1, period))
    while missing:
        def new(x: int) -> set[int]:
            return {d % period for c in cover for d in (x - c, c - x)} & missing
        best = max((x for x in range(period) if x not in cover), key=lambda x: (len(new(x)), -x))
        missing -= new(best)
        cover.append(best)
    return tuple(sorted(cover))


def _codes(text: str) -> np.ndarray:
    """One scrambled 64-bit number per code point."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@Kept
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _room(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def window_hashes(codes: np.ndarray, size: int, starts: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of the ``size`` numbers from each start on."""
    n = len(codes)
    up, down = _powers(base, _room(n)), _powers(pow(base, -1, 1 << 64), _room(n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * up[:n], dtype=np.uint64, out=sums[1:])
    return ((sums[starts + size] - sums[starts]) * down[starts]).view(np.int64)


BASES = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)


#: Hashes that a worker holds before it settles which of them are shared among themselves.
BLOCK = 1 << 20


def _settled(h1: np.ndarray, h2: np.ndarray, classes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """``__k, __class, __v`` of a block of hashes, in their order.

    A hash of one class in the block is sent by itself (``__k`` is the hash).  Of a hash of several classes the first row is
    sent by the hash, marked as shared, the others by their class, marked as well.  ``__v`` packs 31 more bits of the hash, the mark and the position.
    """
    order = np.lexsort((h2, h1))
    a, b, c = h1[order], h2[order], classes[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(first)
    several = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
    shared = np.repeat(several, np.diff(np.append(starts, len(a))))
    aside = np.zeros(len(a), dtype=bool)
    aside[order] = shared & ~first
    marked = np.zeros(len(a), dtype=np.int64)
    marked[order] = shared
    v = np.where(aside, 0, (h2 & 0x3FFFFFFF) << 33) | marked << 32 | at
    return pa.RecordBatch.from_arrays([pa.array(np.where(aside, classes, h1)), pa.array(classes), pa.array(v)], names=["__k", "__class", "__v"])


def _hashed(hashes):
    """Runs ``hashes(text, *more) -> (h1, h2, at)`` over the texts, every class once in a block."""

    def run(batches):
        seen, blocks, n = set(), [], 0
        for b in batches:
            for key, text, *more in zip(*(c.to_pylist() for c in b.columns)):
                if key in seen:
                    continue
                seen.add(key)
                h1, h2, at = hashes(text, *more)
                if len(at):
                    blocks.append((h1, h2, np.full(len(at), key, dtype=np.int64), at.astype(np.int64)))
                    n += len(at)
                if n >= BLOCK:
                    yield _settled(*map(np.concatenate, zip(*blocks)))
                    seen, blocks, n = set(), [], 0
        if blocks:
            yield _settled(*map(np.concatenate, zip(*blocks)))

    return run


def _anchors(length: int, period: int):
    window, cover = length - period + 1, np.array(difference_cover(period))

    def hashes(text):
        codes = _codes(text)
        last = len(codes) - window
        starts = (np.arange(0, last + 1, period)[:, None] + cover).ravel()
        starts = starts[starts <= last]
        h = window_hashes(codes, window, starts, BASES[0])
        return h, np.zeros(len(h), dtype=np.int64), starts

    return _hashed(hashes)


def _windows(length: int, period: int):
    """All windows of the full length that hold a marked anchor."""

    def hashes(text, marks):
        codes = _codes(text)
        last = len(codes) - length
        on = np.zeros(last + 2, dtype=np.int64)
        m = np.asarray(marks, dtype=np.int64)
        np.add.at(on, np.clip(m - period + 1, 0, last + 1), 1)
        np.add.at(on, np.clip(m + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(on)[: last + 1] > 0)
        return window_hashes(codes, length, starts, BASES[0]), window_hashes(codes, length, starts, BASES[1]), starts

    return _hashed(hashes)


def _in_two_classes(rows: DataFrame) -> DataFrame:
    """``__class, __at`` of the hashes that at least two classes have: one shuffle, one pass over sorted rows."""
    w = W.partitionBy("__k", F.shiftrightunsigned("__v", 33))
    both = rows.select("__k", "__class", "__v", F.min("__class").over(w).alias("__lo"), F.max("__class").over(w).alias("__hi"), F.max(F.shiftright("__v", 32).bitwiseAND(F.lit(1))).over(w).alias("__m"))
    return both.where("__lo <> __hi or __m = 1").select("__class", F.col("__v").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("__at"))


def shared_spans(records: DataFrame, length: int = LENGTH, period: int = PERIOD, keys: tuple[str, ...] = ("rec_table", "rec_id"), text: str = "text") -> DataFrame:
    """``*keys, n_chars, shared_chars``: how much of each record stands in spans of at least ``length``
    characters that also stand, exactly, in another record.  One row per record.

    Repeated rows of a record count once; of different texts under one id the one with the least hash counts, a null text only if
    there is no other.  Records with the same whole text form one class, are compared once and all count as shared if they are
    long enough.  A span repeated only inside its own record is not shared.  Null texts have null ``n_chars`` and 0 shared; shorter
    texts have 0; rows with a null id are left out; other columns are ignored; an empty table gives an empty result.
    """
    if not 1 < period < length:
        raise ValueError("the period must be at least 2 and below the length")
    ids = list(keys)
    rows = records
    for k in ids:
        rows = rows.where(F.col(k).isNotNull())
    hashed = F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text).alias("c"), F.length(text).alias("n")))
    members = rows.groupBy(*ids).agg(F.min(hashed).alias("__m")).select(*ids, F.col("__m.c").alias("__class"), F.col("__m.n").alias("n_chars"))
    long = rows.where(F.length(text) >= length).select(F.xxhash64(text).alias("__class"), F.col(text).alias("__text"))
    marks = _in_two_classes(long.mapInArrow(_anchors(length, period), "__k long, __class long, __v long")).groupBy("__class").agg(F.collect_list("__at").alias("__marks"))
    sizes = members.where(F.col("n_chars") >= length).groupBy("__class").agg(F.count(F.lit(1)).alias("__n"))
    texts = long.groupBy("__class").agg(F.first("__text").alias("__text"))
    # a text that is no record's own any more, since another counts under its id, is left out here
    marked = marks.join(sizes, "__class", "left_semi").join(texts, "__class").select("__class", "__text", "__marks")
    found = _in_two_classes(marked.mapInArrow(_windows(length, period), "__k long, __class long, __v long"))
    w = W.partitionBy("__class").orderBy("__at")
    step = F.least(F.lit(length), F.coalesce(F.lead("__at").over(w) - F.col("__at"), F.lit(length)))
    covered = found.withColumn("__step", step).groupBy("__class").agg(F.sum("__step").alias("__covered"))
    out = join_stats(members, sizes.join(covered, "__class", "left"), ["__class"], "__n", ids, how="left")
    shared = F.when(F.col("__n") > 1, F.col("n_chars")).otherwise(F.coalesce(F.col("__covered"), F.lit(0)))
    return out.select(*ids, "n_chars", F.coalesce(shared, F.lit(0)).cast("long").alias("shared_chars"))


ships(__name__)
