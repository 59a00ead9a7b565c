"""Evaluation passages in training text, found with a generalised suffix automaton of the test items.

The automaton of the normalised items (words in lower case) accepts every run of words that
stands in some item.  A document's words are streamed through it; after each word the state
gives the longest run ending there that also stands in an item.  Where that run reaches the
given length, the state's item list names every item that holds the last so many words.

Two kinds of test material need other units.  An item of fewer words than the given length is found
where the whole of it stands.  Scripts without spaces have no words to count: items in them get
a second automaton whose units are single characters there, and words elsewhere.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm._util import ships

MIN_WORDS = 12
#: Fewest words of an item that is shorter than ``MIN_WORDS`` and is looked for as a whole.
WHOLE_WORDS = 5
#: Units of one character or word in a row that count in scripts without spaces; two of them weigh as one word.
MIN_UNITS = 24
#: Units of test items in one automaton; larger test sets are split over several, each streamed over all documents.
AUTOMATON_WORDS = 400_000
WORD = re.compile(r"[^\W_]+")
#: Thai, Lao, Myanmar, Khmer, kana and Chinese characters.
UNSPACED = "ก-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
UNIT = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def unit_places(text: str, unit: re.Pattern = WORD) -> list[tuple[int, int]]:
    """Where the units of the lower-cased text stand in the text itself, also where a letter is longer in lower case."""
    low = text.lower()
    places = [m.span() for m in unit.finditer(low)]
    if len(low) == len(text):
        return places
    at = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(at[a], at[b - 1] + 1) for a, b in places]


word_places = unit_places


class Automaton:
    """Generalised suffix automaton over units, with the items of every state that ends runs of ``least`` of them
    and, where shorter items of ``whole`` units or more end, those."""

    def __init__(self, items: list[tuple[int, str]], least: int, whole: int | None = None, unit: re.Pattern = WORD):
        self.least = least
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[str, int] = {}
        ends: dict[int, set[int]] = {}
        short: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            last, codes = 0, [self.ids.setdefault(w, len(self.ids)) for w in unit.findall(text.lower())]
            if whole is not None and whole <= len(codes) < least:
                short.setdefault(tuple(codes), set()).add(item)
            for c in codes:
                last = self._extend(last, c)
                if self.length[last] >= least:
                    ends.setdefault(last, set()).add(item)
        # an item that ends in a state also ends in the states of its suffixes
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if v in ends and self.link[v] > 0 and self.length[self.link[v]] >= least:
                ends.setdefault(self.link[v], set()).update(ends[v])
        self.items = {v: tuple(sorted(x)) for v, x in ends.items()}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for codes, found in short.items():
            v = 0
            for c in codes:
                v = self.next[v][c]
            self.whole.setdefault(v, []).extend((i, len(codes)) for i in sorted(found))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def packed(self) -> tuple:
        """The automaton as plain arrays: a state's first transition in two of them, the rest, few, in one dictionary.

        Nothing in it is of this package, so a broadcast of it is read once per worker and kept there by Spark."""
        sign, to, more = array("i"), array("i"), {}
        for v, t in enumerate(self.next):
            first = next(iter(t.items())) if v and t else (-1, 0)
            sign.append(first[0])
            to.append(first[1])
            for c, u in t.items():
                if not v or c != first[0]:
                    more[v << 32 | c] = u
        near = array("i", bytes(4 * len(self.next)))  # the nearest state up the links, itself included, where a short item ends
        if self.whole:
            for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                near[v] = v if v in self.whole else near[self.link[v]]
        return self.least, self.ids, sign, to, more, array("i", self.link), array("i", self.length), self.items, self.whole, near

    def scan(self, words: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        longest, _, spans = scan(self.packed(), words)
        return longest, spans


def scan(packed: tuple, words: list[str]) -> tuple[dict[int, int], set[int], list[tuple[int, int]]]:
    """Longest run of each item that the words hold, ``least`` or more; the shorter items they hold as a whole; and
    the matched spans of words, merged."""
    least, ids, sign, to, more, link, length, items, whole, near = packed
    v = n = 0
    longest: dict[int, int] = {}
    entire: set[int] = set()
    spans: list[tuple[int, int]] = []
    for i, word in enumerate(words):
        c = ids.get(word, -1)
        if c < 0:
            v = n = 0
            continue
        while v:
            u = to[v] if sign[v] == c else more.get(v << 32 | c, 0)
            if u:
                break
            v = link[v]
            n = length[v]
        else:
            u = more.get(c, 0)
        v = u
        n = n + 1 if u else 0
        size = n if n >= least else 0
        if size:
            u, run = v, n
            while u > 0 and run >= least:
                for item in items.get(u, ()):
                    if longest.get(item, 0) < run:
                        longest[item] = run
                u = link[u]
                run = length[u]
        u = near[v]
        while u:
            for item, k in whole[u]:
                if k <= (n if u == v else length[u]):
                    entire.add(item)
                    size = max(size, k)
            u = near[link[u]]
        if size:
            a = i + 1 - size
            while spans and spans[-1][1] >= a:
                a = min(a, spans.pop()[0])
            spans.append((a, i + 1))
    return longest, entire, spans


def cleaned(text: str, spans: list[tuple[int, int]], max_words: int, max_coverage: float) -> tuple[str, int, int, int]:
    """The text without matched spans of more than ``max_words`` words, or without all of them if they cover more
    than ``max_coverage`` of its words; the words removed, those matched, and all.  Spans are of characters; one in a script
    without spaces is taken to have half as many words as units, if that is more."""
    places = word_places(text)
    starts, ends = [a for a, _ in places], [b for _, b in places]
    joined: list[list[int]] = []  # first and last character, first and last word; spans with no word between them are one
    for a, b in sorted(spans):
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        if joined and (joined[-1][1] >= a or joined[-1][3] >= i):
            joined[-1][1], joined[-1][3] = max(joined[-1][1], b), max(joined[-1][3], j)
        else:
            joined.append([a, b, i, j])
    sizes = [j - i for _, _, i, j in joined]
    weights = [max(n, sum(1 for _ in UNIT.finditer(text, a, b)) // 2) if HAS_UNSPACED.search(text, a, b) else n for n, (a, b, _, _) in zip(sizes, joined)]
    everything = sum(sizes) > max_coverage * max(1, len(places))
    out, at, gone = [], 0, 0
    for (a, b, _, _), n, w in zip(joined, sizes, weights):
        if everything or w > max_words:
            out.append(text[at:a])
            at = b
            gone += n
    return "".join([*out, text[at:]]), gone, sum(sizes), len(places)


LEAKS = "array<struct<item_id:bigint,kind:string,run:int>>"
SPANS = "array<struct<a:int,b:int>>"


def _shards(items: DataFrame, item: str, text: str, automaton_words: int) -> list[DataFrame]:
    """Parts of the test set of about ``automaton_words`` units each, one if it is small."""
    units = F.size(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))) + F.length(F.regexp_replace(text, f"[^{UNSPACED}]", ""))
    n = max(1, -(-(items.agg(F.sum(units).alias("n")).first()["n"] or 0) // automaton_words))
    return [items.where(F.pmod(F.xxhash64(item), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", least: int = MIN_WORDS, whole: int | None = WHOLE_WORDS,
               least_units: int | None = MIN_UNITS, automaton_words: int = AUTOMATON_WORDS, max_span: int = 24, max_coverage: float = 0.3) -> DataFrame:
    """``doc, n_words, matched_words, leaks array<struct<item_id, kind, run>>, cleaned, removed_words``: one row per document
    that holds material of a test item.

    Words are runs of letters and digits, compared in lower case, whatever stands between them.  A leak is of kind
    ``words``: at least ``least`` words in a row that the item also has in a row, ``run`` being the most; ``whole``: an item of ``whole`` to
    ``least - 1`` words, all of it (None: not looked for); or ``units``: of an item with characters of a script without
    spaces, ``least_units`` such characters or other words in a row, or the whole of an item of at least half as many (None: not looked for).
    ``cleaned`` is the text without the matched spans of all items together that have more than ``max_span`` words, or without all
    of them where they cover more than ``max_coverage`` of the words.  Null texts and documents without a match give no row;
    rows with a null id are left out; a repeated row counts once, different texts under one id have a row each; other columns
    are ignored.  A part of the test set of bounded size makes the automata that are sent with the tasks; every further part is another
    pass over the documents, and what the passes find in a document is put together before it is cleaned.
    """
    docs = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("__d"), F.col(text).alias("__t"))
    found = None
    for part in _shards(items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(item, text), item, text, automaton_words):
        rows = sorted((r[item], r[text]) for r in part.distinct().collect())
        unspaced = [r for r in rows if HAS_UNSPACED.search(r[1])]
        packed = Automaton(rows, least, whole).packed(), Automaton(unspaced, least_units, least_units // 2, UNIT).packed() if unspaced and least_units else None
        sent = docs.sparkSession.sparkContext.broadcast(packed)
        one = docs.mapInArrow(_scanner(sent, least), f"__d long, __t string, __spans {SPANS}, __leaks {LEAKS}")
        found = one if found is None else found.unionByName(one)
    leak = lambda x: x["item_id"].isNotNull()
    per = found.groupBy("__d", F.xxhash64("__t").alias("__h")).agg(F.first("__t").alias("__t"), F.array_distinct(F.flatten(F.collect_list("__spans"))).alias("__spans"),
                                                                   F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("__leaks")), leak))).alias("__leaks"))
    return per.select("__d", "__t", "__spans", "__leaks").mapInArrow(_cleaner(doc, max_span, max_coverage), f"{doc} long, n_words int, matched_words int, leaks {LEAKS}, cleaned string, removed_words int")


def _scanner(sent, least: int):
    leak = pa.list_(pa.struct([("item_id", pa.int64()), ("kind", pa.string()), ("run", pa.int32())]))
    kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), leak)

    def run(batches):
        words, units = sent.value
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                leaks, spans = [], []
                for packed, unit, kind, rest in ((words, WORD, "words", "whole"), (units, UNIT, "units", "units")):
                    if packed is None or unit is UNIT and not HAS_UNSPACED.search(t):
                        continue
                    longest, entire, at = scan(packed, unit.findall(t.lower()))
                    if at:
                        places = unit_places(t, unit)
                        spans += [{"a": places[x][0], "b": places[y - 1][1]} for x, y in at]
                        leaks += [{"item_id": i, "kind": kind, "run": n} for i, n in longest.items()] + [{"item_id": i, "kind": rest, "run": 0} for i in entire if i not in longest]
                if leaks:
                    rows.append((d, t, spans, leaks))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), kinds)], names=["__d", "__t", "__spans", "__leaks"])

    return run


def _cleaner(out_doc: str, max_span: int, max_coverage: float):
    def run(batches):
        for b in batches:
            rows = [cleaned(t, [(s["a"], s["b"]) for s in spans], max_span, max_coverage) for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            text, gone, matched, n = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(matched, pa.int32()), b.column(3), pa.array(text, pa.string()), pa.array(gone, pa.int32())],
                                             names=[out_doc, "n_words", "matched_words", "leaks", "cleaned", "removed_words"])

    return run


def leaked_pairs(leaks: DataFrame, doc: str = "doc_id", kinds: tuple[str, ...] = ("words",)) -> DataFrame:
    """``item_id, doc, run``: one row per test item and document, with the longest run of words they share; by default only the runs of words."""
    return leaks.select(doc, F.explode("leaks").alias("__l")).where(F.col("__l.kind").isin(*kinds)).groupBy(F.col("__l.item_id").alias("item_id"), doc).agg(F.max("__l.run").alias("run"))


ships(__name__)
