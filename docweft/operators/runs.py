"""The longest runs of words of many answers that stand in a block of texts, through one sorted array of suffixes.

Texts and answers are normalised: words parted by single blanks.  A run is a substring of a text, so its first word may be the end of
a longer one and its last word the beginning of one.  What stands with a run stands with each shorter one from the same start, so
for rarity only the longest run from each start counts, and the work grows with the length of an answer and not with its square.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from docweft.session import ships


def _ranks(seq: np.ndarray, words: int) -> np.ndarray:
    """Order of the suffixes of ``seq`` by their first ``words`` numbers."""
    rank, k = seq, 1
    while k < words:
        key = rank * (rank.max() + 1)
        key[:-k] += rank[k:]
        rank = np.unique(key, return_inverse=True)[1]
        k *= 2
    return rank


def _ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def longest_runs(texts: list[str], answers: list[str], least: int, most: int) -> tuple[np.ndarray, ...]:
    """Arrays ``answer, start, size, n`` and a list of ``texts``: from each start the longest run of ``least`` or more of the answer's words that a
    text has, the number of texts that have it (``most + 1`` stands for more than ``most``) and their places.
    """
    none = np.zeros(0, np.int64)
    kept = [i for i, a in enumerate(answers) if a.count(" ") >= least - 1]
    parts = [t.split(" ") for t in texts] + [answers[i].split(" ") for i in kept]
    if not texts or not kept:
        return none, none, none, none, np.zeros((0, most), np.int64)
    vocabulary = sorted({w for p in parts for w in p})
    number = {w: i for i, w in enumerate(vocabulary, 1)}
    lengths = np.array([len(p) for p in parts])
    begin = np.cumsum(lengths + 1) - lengths - 1
    seq = np.zeros(begin[-1] + lengths[-1] + 1, np.int64)
    seq[np.repeat(begin, lengths) + _ragged(lengths)] = np.fromiter((number[w] for p in parts for w in p), np.int64, lengths.sum())
    rank = _ranks(seq, int(lengths[len(texts):].max()))
    width = int(rank.max()) + 1

    starts = lengths[len(texts):] - least + 1
    answer, start = np.repeat(np.arange(len(kept)), starts), _ragged(starts)
    at = begin[len(texts):][answer] + start
    first, rest = seq[at], at + 1

    # an entry for each word of a text and each first word of a run that it ends with: where the next word is
    firsts = {vocabulary[i - 1] for i in np.unique(first).tolist()}
    reach = max(map(len, firsts))
    own = np.zeros(len(vocabulary) + 1, bool)
    n_text = begin[len(texts)]
    own[seq[:n_text]] = True
    ends = [[number[w[j:]] for j in range(max(0, len(w) - reach), len(w)) if w[j:] in firsts] if own[i] else [] for i, w in enumerate(vocabulary, 1)]
    n_ends = np.array([0, *map(len, ends)])
    flat, from_ = np.array([x for e in ends for x in e], np.int64), np.cumsum(n_ends) - n_ends
    words = seq[:n_text]
    each = n_ends[words]
    each[words == 0] = 0
    entry = np.repeat(np.arange(n_text), each) + 1
    if not len(entry):
        return none, none, none, none, np.zeros((0, most), np.int64)
    entry_first = flat[np.repeat(from_[words], each) + _ragged(each)]
    key = entry_first * width + rank[entry]
    order = np.argsort(key, kind="stable")
    entry, entry_first, key = entry[order], entry_first[order], key[order]
    text_of = np.repeat(np.arange(len(texts)), lengths[: len(texts)] + 1)
    spot = np.searchsorted(key, first * width + rank[rest])
    beyond = np.zeros(len(vocabulary) + 1, np.int64)  # the words that begin with a word are those up to here
    for i in np.unique(seq[n_text:]).tolist():
        if i:
            beyond[i] = bisect_left(vocabulary, vocabulary[i - 1] + chr(0x10FFFF)) + 1

    def size(run: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Words of ``run`` that stand at entry ``e``."""
        inside = (e >= 0) & (e < len(entry))
        e = np.where(inside, e, 0)
        ok = inside & (entry_first[e] == first[run])
        a, b, same = rest[run], entry[e], np.zeros(len(run), np.int64)
        going = np.flatnonzero(ok)
        while len(going):
            x = seq[a[going] + same[going]]
            going = going[(x > 0) & (x == seq[b[going] + same[going]])]
            same[going] += 1
        x, y = seq[np.where(ok, a + same, 0)], seq[np.where(ok, b + same, 0)]
        part = (seq[np.where(ok, a + same, 0)] > 0) & (y > x) & (y < beyond[x])
        return np.where(ok, 1 + same + part, 0)

    every = np.arange(len(first))
    longest = np.maximum(size(every, spot - 1), size(every, spot))
    found, n = np.full((len(first), most + 1), -1), np.zeros(len(first), np.int64)
    for step, e in ((-1, spot - 1), (1, spot.copy())):
        going = np.flatnonzero((longest >= least) & (n <= most))
        while len(going):
            going = going[size(going, e[going]) >= longest[going]]
            text = text_of[entry[e[going]]]
            new = ~(found[going] == text[:, None]).any(axis=1)
            found[going[new], n[going[new]]] = text[new]
            n[going[new]] += 1
            e[going] += step
            going = going[n[going] <= most]
    hit = np.flatnonzero(longest >= least)
    return np.array(kept, np.int64)[answer[hit]], start[hit], longest[hit], n[hit], found[hit, :most]


ships(__name__)
