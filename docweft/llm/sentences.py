"""Sentence boundaries across languages and scripts, with a maximum-entropy classifier.

Candidates are the ends of runs of closing punctuation (with the quotes and brackets that close
there) and, in Thai script, which has no such marks, the blanks.  Every candidate is classified from
its neighbours: the tokens on either side, their case, length, digits and script, the mark itself, and
whether it stands inside a quotation or bracket that is part of a running sentence.

Training needs no labels.  The ends of paragraphs, with the start of the paragraph that follows,
are reliable boundaries; candidates inside paragraphs are unlabelled, boundaries or not.
A logistic model of "is a paragraph's end" then gives a true boundary about the same probability
wherever it stands and an abbreviation next to none, so the cut lies at a share of the median
probability over the reliable ones.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm._util import ships
from docweft.session import Kept

#: Most candidates the model is fitted on; a documented bound, since the fit runs on the driver.
TRAINING_ROWS = 150_000
#: Documents whose candidates are looked at for training, picked by a hash of their id.
TRAINING_DOCUMENTS = 8_500
DIMENSIONS = 1 << 16
#: A candidate is a boundary if its probability exceeds this share of the median over the reliable boundaries.
SHARE = 0.25

MARKS = ".!?。！？｡।॥።፧؟۔…"
#: Marks that end a sentence without white space after them.
UNSPACED = "。！？｡।॥።፧؟…"
CANDIDATE = re.compile(rf"[{MARKS}]+(?:[\"'”’»›)\]}}」』）】》〉“]|[   ](?=»))*|(?<=[฀-๿0-9A-Za-z%])\s+(?=[฀-๿])|(?<=[฀-๿])\s+(?=[0-9A-Za-z])")
BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r\n[^\S\n]*\r\n\s*| ")
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "【": "】", "„": "“", "‹": "›"}
ENCLOSING = re.compile("[\"" + re.escape("".join([*PAIRS, *PAIRS.values()])) + "]")
ITEM = re.compile(r"\s*(?:[(\[]?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)\]]+|[-–—•*·▪])\s*$")
NEXT_ITEM = re.compile(r"[-–—•*·▪]\s|[(\[]?\d{1,3}[.)\]]\s")
OPENERS = "\"'“‘«‹(（[「『【《„¿¡-–—•* "


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines that hold more than white space, trimmed at both ends."""
    out, at = [], 0
    for m in [*BLANK_LINE.finditer(text), None]:
        a, b = at, m.start() if m else len(text)
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        if m:
            at = m.end()
    return out


def enclosed(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans (opening mark, closing mark) of the outermost closed quotations and brackets in ``text[a:b]``.

    A straight quote after a digit, with no quotation open, is the sign of inches and opens none."""
    spans, stack = [], []
    straight = -1
    for m in ENCLOSING.finditer(text, a, b):
        i, c = m.start(), m.group()
        if c == '"':
            if straight >= 0:
                spans.append((straight, i))
                straight = -1
            elif not (i > a and text[i - 1].isdigit()):
                straight = i
        elif stack and c == stack[-1][0]:
            spans.append((stack.pop()[1], i))
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
        elif c in "”»」』）)]》】›" and any(c == s[0] for s in stack):
            while stack[-1][0] != c:
                stack.pop()
            spans.append((stack.pop()[1], i))
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s in spans:
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    return outer


def runs_on(text: str, a: int, b: int, i: int, j: int) -> bool:
    """Whether the quotation or bracket from ``i`` to ``j`` is part of a running sentence: text leads into it, or out of it,
    or it does not end with a closing mark."""
    k = i - 1
    while k >= a and text[k].isspace():
        k -= 1
    if k >= a and text[k] not in MARKS and text[k] not in "”»」』）)]》】›\"":
        return True
    if text[j - 1] not in MARKS:
        return True
    k = j + 1
    while k < b and text[k].isspace():
        k += 1
    return k < b and (k == j + 1 or not (text[k].isupper() or text[k] in OPENERS or _class(text[k]) in "DRE"))


@Kept
def _class(c: str) -> str:
    o = ord(c)
    if c.isdigit():
        return "9"
    if o < 0x370 or 0x1E00 <= o < 0x2000 or 0x400 <= o < 0x530:
        return "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else "."
    for name, lo, hi in (("T", 0xE00, 0xE80), ("D", 0x900, 0x980), ("R", 0x600, 0x780), ("E", 0x1200, 0x1400), ("K", 0x3040, 0x3100), ("H", 0x3400, 0xA000), ("K", 0xAC00, 0xD7B0)):
        if lo <= o < hi:
            return name if c.isalpha() else "_" if c.isspace() else name.lower()
    return "o" if c.isalpha() else "_" if c.isspace() else "."


@Kept
def _shape(token: str) -> str:
    out = ""
    for c in token[:8]:
        k = _class(c)
        if not out or out[-1] != k:
            out += k
    return out


@Kept
def _normal(token: str) -> str:
    return re.sub(r"\d+", "0", token.lower())


DENSE = "HKT"


@Kept
def _before(left: str, blank: bool) -> tuple:
    """Of the text before a mark: its last word, the one before, shape, length, whether it has a full stop inside, and the last character's class."""
    lt = left.rsplit(None, 2)
    l1 = (lt[-1] if lt and not left[-1:].isspace() else "").lstrip(OPENERS)
    l2 = _normal(lt[-2].rsplit(None, 1)[-1]) if len(lt) > 1 else "^"
    kl = _class(l1[-1:] or " ")
    if kl in DENSE or l1 == "" and blank:
        l1, l2 = left.strip()[-3:], left.strip()[-6:]
    return _normal(l1), l2, _shape(l1), min(len(l1), 6), "." in l1, kl


@Kept
def _after(follow: str) -> tuple:
    """Of the text after a mark: its first word, the next, shape, opening mark, case and the first character's class."""
    bare = follow.lstrip(OPENERS)
    ft = bare.split(None, 2)
    r1 = ft[0].rstrip(",;:") if ft else ""
    r2 = _normal(ft[1]) if len(ft) > 1 else ""
    kr = _class(bare[:1] or " ")
    if kr in DENSE:
        r1, r2 = bare[:2], bare[:4]
    case = "camel" if len(r1) > 1 and r1[0].islower() and r1[1].isupper() else kr + ("s" if len(r1) == 1 else "")
    return _normal(r1), r2, _shape(r1), follow[:1] if follow[:1] in OPENERS else "", case, kr


@Kept
def _mark(mark: str) -> tuple[str, str]:
    """Closing quotes and brackets of a run of marks, and the marks before them."""
    return mark.strip(MARKS + " "), mark.rstrip("\"'”’»›)]}」』）】》〉“   ")[:3]


#: Two words and what stands before, at most so many characters, are all that is looked at on either side.
REACH = 40


def around(text: str, a: int, start: int, end: int, right: int, b: int, right_text: str | None = None) -> tuple[str, str, str]:
    """What stands before a candidate, its marks, and what follows, as far as features look: two words on either side, ``REACH`` characters at most.

    The candidate's mark begins at ``start`` and its closing marks end at ``end``; ``a`` and ``b`` bound the paragraph,
    ``right`` is where the next token begins.  ``right_text`` stands in for what follows, for a paragraph's end.
    """
    left = text[max(a, start - REACH) : start]
    follow = text[right : min(b, right + REACH)] if right_text is None else right_text[:REACH]
    if left.isascii() and "  " not in left:
        cut = left.rfind(" ", 0, max(0, left.rfind(" ", 0, len(left) - 1)))
        if cut > 0:
            left = left[cut + 1 :]
    if follow[:1].isalnum() and follow.isascii() and "  " not in follow:
        cut = follow.find(" ", follow.find(" ") + 1) if " " in follow else -1
        if cut > 2:
            follow = follow[:cut]
    return left, " " if text[start].isspace() else text[start:end], follow


def contexts(left: str, mark: str, follow: str, inside: bool = False) -> tuple[tuple, ...]:
    """What the features of a candidate depend on, in six groups that recur; ``inside``: it is in a quotation or bracket of a running sentence."""
    n1, l2, sl, size, inner, kl = _before(left, mark == " ")
    m1, r2, sr, opener, case, kr = _after(follow)
    closing, what = _mark(mark)
    return (("L", n1, l2, sl, size), ("R", m1, r2, sr, opener), ("X", what, closing, case, sl, size, inner, opener, kl, kr, inside), ("C", n1, case), ("K", closing, m1, kl, what), ("P", l2, case, size))


@Kept
def numbers(group: tuple) -> tuple[int, ...]:
    """Feature numbers of one group."""
    kind, *x = group
    if kind == "L":
        n1, l2, sl, size = x
        f = [f"l{n1}", f"ll{l2} {n1}", f"L{sl}|{size}", f"t{n1[-3:]}"]
    elif kind == "R":
        m1, r2, sr, opener = x
        f = [f"r{m1}", f"rr{m1} {r2}", f"R{sr}", f"R{sr}|{opener}"]
    elif kind == "X":
        what, closing, case, sl, size, inner, opener, kl, kr, inside = x
        f = [f"m{what}", f"m{what}|{closing}|{case}", f"c{closing}|{case}", f"L{sl}|{size}|{case}", f"i{inner}|{size}|{case}", f"x{what}|{case}|{sl[-1:]}", f"o{opener}|{case}", f"s{kl}{kr}", f"q{inside}"]
    elif kind == "C":
        f = [f"l{x[0]}|{x[1]}"]
    elif kind == "K":
        closing, m1, kl, what = x
        f = [f"k{closing}|{m1}", f"d{kl}|{what}|{m1}"]
    else:
        f = [f"p{x[0]}|{x[1]}|{x[2]}"]
    return tuple(zlib.crc32(i.encode()) & (DIMENSIONS - 1) for i in f)


def features(*at, inside: bool = False, **kw) -> list[int]:
    """Feature numbers of a candidate, see ``around``."""
    return [i for g in contexts(*around(*at, **kw), inside) for i in numbers(g)]


N_FEATURES = 21


def candidates(text: str, a: int, b: int):
    """``(mark start, end, next start, newline between, item, inside)`` of the candidates in a paragraph, but for its end."""
    closed = enclosed(text, a, b) if ENCLOSING.search(text, a, b) else []
    running = [runs_on(text, a, b, i, j) for i, j in closed]
    k = 0
    for m in CANDIDATE.finditer(text, a, b):
        start, end = m.span()
        if text[start].isspace():
            right, end = end, start
        else:
            # a quote that opens the next sentence is not part of this one
            while closed and end > start and text[end - 1] in "\"'“" and any(s[0] == end - 1 for s in closed):
                end -= 1
            right = end
            while right < b and text[right].isspace():
                right += 1
        if right >= b:
            return
        within = False
        if closed:
            while k < len(closed) and closed[k][1] < end - 1:
                k += 1
            within = k < len(closed) and closed[k][0] < end and closed[k][1] >= end and running[k]
        c, n = text[right], text[right + 1 : right + 2]
        if right == end and not text[start].isspace():
            # nothing between: only marks that need no white space, or a word that plainly begins
            mark = text[start:end]
            if not any(x in UNSPACED for x in mark) and not (c in OPENERS or c.isupper() and (n.islower() or n.isspace()) or c.islower() and n.isupper() or mark[0] in "!?" and c.isalpha()):
                continue
            if c in ",;:.،，、；：)" or (c in "-–—" and not any(x in UNSPACED for x in mark)):
                continue
            if mark == "." and c in "\"'“‘(" and text[start - 1 : start].isdigit() and n.isdigit():
                continue
        elif c in ",;،，、；":
            continue
        newline = "\n" in text[end:right]
        yield start, end, right, newline, newline and NEXT_ITEM.match(text, right) is not None, within


def training_examples(text: str) -> list[tuple[int, list[int]]]:
    """``(1, features)`` of the reliable boundaries and ``(0, features)`` of the unlabelled candidates."""
    out = []
    spans = paragraphs(text)
    for k, (a, b) in enumerate(spans):
        for start, end, right, newline, item, inside in candidates(text, a, b):
            line = text[max(a, text.rfind("\n", a, start) + 1) : end]
            if not item and not ITEM.fullmatch(line):
                out.append((0, features(text, a, start, end, right, b, inside=inside)))
        if k + 1 < len(spans):
            c, d = spans[k + 1]
            tail = re.search(rf"[{MARKS}]+[\"'”’»›)\]}}」』）】》〉“   ]*$", text[max(a, b - 12) : b])
            start = b if tail is None else max(a, b - 12) + tail.start()
            after = text[c : min(d, c + 40)]
            thai = tail is None and _class(text[b - 1]) == "T" and _class(after[:1]) == "T"
            if tail is not None and re.search(rf"[{MARKS}][\"'”’»›)\]}}」』）】》〉“]*$", text[c:d]):
                out.append((1, features(text, a, start, b, c, d, right_text=after)))
            elif thai and d - c > 18 and b - a > 18:
                out.append((1, features(text + " ", a, b, b, c, d, right_text=after)))
    return out


#: Abbreviations that are followed by what they belong to, by language; only a prior, which counts overrule.
ABBREVIATIONS = """
Dr Mr Mrs Ms Prof Rev Hon Capt Lt Col Gen Sgt Eng St Mt Ft Sen Rep Gov Messrs No Nos Fig Figs Sec Art Vol Ch Cl Para pp ed eds vs cf ca approx incl excl tel ext dept bldg apt ref inv qty e.g i.e viz al
M Mme Mlle MM Mgr p ex p.ex cf n art chap env éd
Sr Sra Srta Dra Lic núm pág p.ej ej aprox n.º art av D Dña
Hr Fr Frau Nr Str bzw z B z.B d h d.h ca vgl usw bspw evtl ggf inkl zzgl Abs Art Kap S
Bw Bi Dk Na Mh k.m n.k k m n uk
डॉ श्री सं रु लि प्रो पं
د أ م ص ج رقم
ቁ ዶ/ር ገጽ አ.አ
""".split()


def _prior() -> np.ndarray:
    w = np.zeros(DIMENSIONS)
    for a in ABBREVIATIONS:
        w[zlib.crc32(f"l{_normal(a)}".encode()) & (DIMENSIONS - 1)] = -2.5
    for closing in ("", '"', "”", "»", ")", "」", "’", "“"):
        w[zlib.crc32(f"c{closing}|a".encode()) & (DIMENSIONS - 1)] = -3.0
    w[zlib.crc32(b"qTrue") & (DIMENSIONS - 1)] = -6.0
    for mark in "。？！।።؟":
        w[zlib.crc32(f"m{mark}".encode()) & (DIMENSIONS - 1)] = 0.5
    return w


@dataclass
class BoundaryModel:
    """Weights of the logistic model and the least score of a boundary."""

    weights: np.ndarray
    bias: float
    least: float
    kept: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def score(self, groups: tuple[tuple, ...]) -> float:
        kept, total = self.kept, self.bias
        for g in groups:
            v = kept.get(g)
            if v is None:
                if len(kept) > 1 << 18:
                    kept.clear()
                v = kept[g] = float(sum(self.weights[i] for i in numbers(g)))
            total += v
        return total

    def ends(self, text: str) -> list[int]:
        """End positions of the text's sentence units, ascending."""
        out = []
        for a, b in paragraphs(text):
            since = a
            for start, end, right, newline, item, inside in candidates(text, a, b):
                if end - since < 40 and ITEM.fullmatch(text[since:end]):
                    continue
                if item and not inside or self.score(contexts(*around(text, a, start, end, right, b), inside)) > self.least:
                    out.append(end)
                    since = right
            out.append(b)
        return out


def fit(labels: np.ndarray, feats: np.ndarray, rounds: int = 200, strength: float = 7.0, min_count: int = 2) -> BoundaryModel:
    """Full-batch logistic regression with adaptive steps, as if ``strength`` observations held every weight at its prior.

    Features seen less than ``min_count`` times stay there."""
    y = labels.astype(np.float64)
    prior = _prior()
    w, g2 = prior.copy(), np.full(DIMENSIONS, 1e-8)
    if not len(y) or y.all() or not y.any():
        return BoundaryModel(w, 0.0, -1.0)
    n = len(y)
    rare = np.bincount(feats.ravel(), minlength=DIMENSIONS) < min_count
    p = y.mean()
    bias, gb2 = float(np.log(p / (1 - p))), 1e-8
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-(bias + w[feats].sum(1))))
        err = (prob - y) / n
        g = np.bincount(feats.ravel(), np.repeat(err, feats.shape[1]), DIMENSIONS) + strength / n * (w - prior)
        g[rare] = 0
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        gb = err.sum()
        gb2 += gb * gb
        bias -= 0.2 * gb / np.sqrt(gb2)
    prob = 1 / (1 + np.exp(-(bias + w[feats].sum(1))))
    cut = min(0.5, SHARE * float(np.median(prob[labels == 1])))
    return BoundaryModel(w.astype(np.float32), bias, float(np.log(cut / (1 - cut))))


def train(documents: DataFrame, doc: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS, sample: int = TRAINING_DOCUMENTS) -> BoundaryModel:
    """Fit on at most ``rows`` candidates of about ``sample`` documents, picked by hash: the same rows give the same model."""
    total = documents.count()
    of = 1 << 20
    picked = documents.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(doc), F.lit(of)) < max(1, min(of, round(of * sample / max(1, total))))))

    def run(batches):
        for b in batches:
            keys, labels, feats = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, (y, f) in enumerate(training_examples(t)):
                    keys.append(zlib.crc32(f"{d} {k}".encode()))
                    labels.append(y)
                    feats.append(f)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels, pa.int32()), pa.array(feats, pa.list_(pa.int32()))], names=["k", "y", "f"])

    got = picked.select(F.col(doc).cast("string"), text).mapInArrow(run, "k long, y int, f array<int>").orderBy("k", "y", "f").limit(rows).toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    f = got.column("f").combine_chunks().flatten().to_numpy().reshape(len(y), N_FEATURES).astype(np.int64) if len(y) else np.zeros((0, N_FEATURES), np.int64)
    return fit(y, f)


def sentence_ends(documents: DataFrame, model: BoundaryModel | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, sent_no, char_start, end_pos``: one row per sentence unit, in order.

    Positions are code points; ``end_pos`` lies after the unit's last character that is not white space.
    Null and blank texts have no units, rows with a null id are left out; repeated rows give repeated results,
    other columns are ignored.  Without ``model`` one is trained on these documents; with no reliable boundary in
    them every candidate is one.
    """
    model = model or train(documents, doc, text)

    def run(batches):
        for b in batches:
            ids, starts, no, ends = [], [], [], []
            known: dict[str, list[int]] = {}
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                if t not in known:
                    known[t] = model.ends(t)
                for k, e in enumerate(known[t]):
                    while at < e and t[at].isspace():
                        at += 1
                    ids.append(d)
                    no.append(k)
                    starts.append(at)
                    ends.append(e)
                    at = e
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[doc, "sent_no", "char_start", "end_pos"])

    id_type = documents.schema[doc].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    docs = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, text)
    return docs.mapInArrow(run, f"`{doc}` {id_type}, sent_no int, char_start int, end_pos int")


ships(__name__)
