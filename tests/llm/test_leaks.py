import random
import re

import pytest

from docweft.llm import contamination as C


def brute_cleaned(text, items, least, max_span, max_coverage):
    """``cleaned, matched, items`` by looking at every run of words of every item."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    low = [text[a:b].lower() for a, b in words]
    hit, found = [False] * len(low), set()
    for i, t in items:
        w = C.words_of(t)
        grams = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        if C.WHOLE_WORDS <= len(w) < least:
            grams.add(tuple(w))
        for n in {len(g) for g in grams}:
            for k in range(len(low) - n + 1):
                if tuple(low[k : k + n]) in grams:
                    found.add(i)
                    hit[k : k + n] = [True] * n
    runs, k = [], 0
    while k < len(hit):
        e = k
        while e < len(hit) and hit[e]:
            e += 1
        if e > k:
            runs.append((k, e))
        k = max(e, k + 1)
    # spans that touch are one only where they overlap or the next begins at the very end of the last
    drop = [r for r in runs if sum(hit) > max_coverage * max(1, len(low)) or r[1] - r[0] > max_span]
    out, at = "", 0
    for a, b in drop:
        out += text[at : words[a][0]]
        at = words[b - 1][1]
    return out + text[at:], sum(hit), found


@pytest.mark.parametrize("units", [10**6, 30])
def test_cleaned_texts_against_brute_force(spark, units):
    rng = random.Random(21)
    vocabulary = [a + b for a in "bcdfgklm" for b in ("an", "el", "ir", "os", "ut")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([5, 6, 7, 14, 20, 30]))) for i in range(30)] + [(90, ""), (91, "ban")]
    docs = []
    for i in range(80):
        parts = [text(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            w = C.words_of(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 8))
            parts += [(" - ".join(w[a:]) if rng.random() < 0.5 else " ".join(w)).title(), "| sep |", text(rng.randint(1, 25))]
        docs.append((i, ", ".join(p for p in parts if p)))
    d, h = spark.createDataFrame([*docs, docs[0], (500, None)], "doc_id bigint, text string"), spark.createDataFrame([*items, (92, None)], "item_id bigint, text string")
    got = {r.doc_id: r for r in C.find_leaks(d, h, least=8, max_span=10, max_coverage=0.6, automaton_words=units).collect()}
    n = 0
    for i, t in docs:
        clean, matched, found = brute_cleaned(t, [(i, x) for i, x in items], 8, 10, 0.6)
        if found:
            n += 1
            r = got.pop(i)
            assert (r.cleaned, r.matched_words, {x.item_id for x in r.leaks}, r.n_words) == (clean, matched, found, len(C.words_of(t)))
    assert n > 20 and not got


def test_a_repeated_row_gives_one_row_and_parts_are_put_together(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    text = f"Start {a} middle words stay here {b} end."
    d = spark.createDataFrame([(1, text), (1, text), (1, "other text " + a)], "doc_id bigint, text string")
    h = spark.createDataFrame([(i, t) for i, t in enumerate([a, b])], "item_id bigint, text string")
    rows = sorted(C.find_leaks(d, h, max_span=5, max_coverage=1.0, automaton_words=20).collect(), key=lambda r: r.cleaned)
    assert [r.cleaned for r in rows] == ["Start  middle words stay here  end.", "other text "] and [len(r.leaks) for r in rows] == [2, 1]


def test_short_items_count_as_a_whole_only(spark):
    d = spark.createDataFrame([(1, "He said: when does the shop open again? Then left."), (2, "when does the shop open")], "doc_id bigint, text string")
    h = spark.createDataFrame([(7, "When does the shop open again?"), (8, "He said when"), (9, "shop open again then left him")], "item_id bigint, text string")
    r = C.find_leaks(d, h).collect()
    assert [(x.doc_id, [(y.item_id, y.kind) for y in x.leaks]) for x in r] == [(1, [(7, "whole")])]
    assert C.leaked_pairs(C.find_leaks(d, h)).count() == 0 and C.find_leaks(d, h, whole=None).count() == 0


PIECES = {"zh": ("您可以在收货后退回订单请保留收据费用是价格卖家回复工单仓库每周一关闭货物重量不得超过规定", "，。"), "ja": ("返品は商品到着後にお願いします店舗の営業時間カードで支払う会社規則によると配達先", "、。"),
          "th": ("ผู้ขายต้องคืนเงินภายในวันร้านเปิดทำการทุกสินค้าอื่นส่งกล่องพร้อม", " ")}


@pytest.mark.parametrize("lang", PIECES)
def test_recall_in_scripts_without_spaces(spark, lang):
    letters, gaps = PIECES[lang]
    rng = random.Random(lang)
    text = lambda n: "".join(rng.choice(letters) + (rng.choice(gaps) if rng.random() < 0.08 else "") for _ in range(n))
    items = [(i, text(rng.randint(60, 160))) for i in range(40)]
    docs, want = [], set()
    for i in range(150):
        t = text(300)
        if i % 2:
            item, full = rng.choice(items)
            a = 0 if i % 4 == 1 else rng.randint(0, len(full) - 45)
            cut = full if i % 4 == 1 else full[a : a + 45]
            t = t[:100] + cut + t[100:]
            want.add((item, i))
        docs.append((i, t))
    d, h = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in C.leaked_pairs(C.find_leaks(d, h), kinds=("units",)).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.98 * len(got)
