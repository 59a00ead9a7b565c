import random
import re

import pytest
from pyspark.sql import functions as F

from docweft.llm import contamination as C
from docweft.llm import mixing as M
from docweft.llm import pair_defects as P
from docweft.llm import sentences as N
from docweft.llm import splitting as L

GOOD = [
    ("What fee is due?", "48,555 per week", "48,555 per week"), ("What fee is due?", "The fee is 48,555 per week [3]", "48,555 per week"), ("Which code?", "At the hub (see [3])", "at the hub"),
    ("What fee is due?", "We are sorry for the delay: the fee is 48,555.", "48,555"), ("What fee is due at the hub?", "What fee is due at the hub? The fee is 12.", "12"),
    ("What fee is due at the hub?", '"Politique de retour" is the title; the fee is 12.', "12"), ("Où retirer la commande ?", "au guichet principal", "au guichet principal"), ("Is it sold?", "I cannot answer this question.", None),
    ("What fee is due?", "NOT_IN_STOCK is the flag; the fee is 12.", "12"), ("What is sold?", "Lamps, bags, etc.", "lamps"), ("What is the fee?", "If this cannot be done, the seller will not refuse a later request.", "x"),
]
BAD = {
    "empty": [None, "", " \t", "​", " ", "-", "...", "N/A", "null", "[]", "Answer:"],
    "refusal": ["I don't know.", "NOT_IN_DOCUMENTS", "not_in_documents", "Les documents fournis ne contiennent pas cette information.", "Samahani, siwezi kujibu swali hili.", "As a language model I do not have access to that.", "No puedo responder a esa pregunta.", "Diese Frage kann ich leider nicht beantworten; ich habe keine Angaben.", "无法回答这个问题。", "The passages say nothing on this point."],
    "copies_question": ["What fee is due at the hub?", "WHAT FEE IS DUE AT THE HUB?", "Q: What fee is due at the hub?\nA:", 'The question is "What fee is due at the hub?".', "You asked: what  fee is due at the hub"],
    "other_language": ["根据文件，商店在收货后接受退货。", "وفقا للوثائق تقبل الشركة الطلب.", "Laut den Unterlagen nimmt die Firma den Antrag innerhalb von 3 Tagen an.", "Kwa mujibu wa hati, duka hupokea ombi ndani ya siku 3.", "De acordo com os documentos, a loja aceita o pedido até 3 dias depois da entrega."],
    "truncated": ["The fee is due at the", "The fee is 12 per week (see", "1. The fee is 12 per week.\n2. ", "The fee is 12 per week,", "The fee is 12 per…", 'It says: "the fee', "The fee is 12. This rule holds for regis"],
}


def test_pair_defects(spark):
    rows = [(i, q, a, g) for i, (q, a, g) in enumerate(GOOD)]
    want = {i: None for i in range(len(GOOD))}
    for kind, answers in BAD.items():
        for a in answers:
            want[len(rows)] = kind
            rows.append((len(rows), "What fee is due at the hub?", a, "12 per week"))
    rows += [(900, "What fee is due?", "The fee is due at the hub. This rule holds for registered firms.", "x"), (901, None, "Fine.", None), (rows[0][0], *rows[0][1:]), (None, "q", "a", "g")]
    d = spark.createDataFrame(rows, "answer_id bigint, question string, answer string, gold_answer string").withColumn("defects", F.lit("clash"))
    got = {r.answer_id: r.main for r in P.pair_defects(d).collect()}
    want |= {900: None, 901: None}
    assert {k: (rows[k][2] if k < 900 else "", v, want[k]) for k, v in got.items() if v != want[k]} == {} and set(got) == set(want)
    assert P.pair_defects(d.limit(0)).count() == 0


def check_pieces(text, limit, overlap):
    ps = L.split_text(text, limit, overlap)
    assert ps[0]["char_start"] == 0 and ps[-1]["char_end"] == len(text)
    assert "".join(text[p["core_start"] : p["char_end"]] for p in ps) == text  # exact round trip
    assert all(p["n_tokens"] <= limit for p in ps)
    for a, b in zip(ps, ps[1:]):
        assert a["char_start"] <= b["char_start"] <= b["core_start"] == a["char_end"]
        # about the wanted overlap, at every cut, unless the piece before is shorter
        assert b["core_start"] - b["char_start"] >= min(a["char_end"] - a["char_start"], 0.7 * (overlap - 1) * 3.5 - 4)
    if len(ps) > 1:
        assert ps[0]["cut_kind"] == ("forced" if L.tokens_of(L.longest_stretch(text)) > limit else "natural")
    return ps


def test_splitting_round_trips():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "Ende. ", "x", "字", "\n", "\n\n", "! ", "😀" * 9]) for _ in range(rng.randint(1, 900)))
        for limit, overlap in ((400, 40), (50, 5), (20, 0), (7, 3)):
            check_pieces(text, limit, overlap)


def test_every_cut_repeats_the_overlap():
    ps = check_pieces(("A sentence of one thousand and more letters " * 32)[:1380].strip().join(["", ". "]) * 6, 400, 40)
    assert all(120 < p["core_start"] - p["char_start"] <= 140 for p in ps[1:]) and {p["cut"] for p in ps} == {"whole", "natural", "room"}
    long = check_pieces("Short one. " * 40 + "x" * 3000 + ".\nEnd of it.", 400, 40)
    assert {p["cut"] for p in long} == {"whole", "natural", "forced"} and {p["cut_kind"] for p in long} == {"forced"}
    # 1399 characters are 400 tokens, and the line break after them is a boundary of its own
    assert L.split_text(("y" * 1399 + "\n") * 3)[0]["cut_kind"] == "natural" and L.split_text(("y" * 1400 + "\n") * 3)[0]["cut_kind"] == "forced"


def test_splitting_prefers_strong_boundaries():
    text = ("One sentence here. " * 40 + "\n\n") * 2
    cut = check_pieces(text, 400, 40)[1]["core_start"]
    assert text[:cut].endswith("\n\n") and L.split_text(text)[0]["cut_kind"] == "natural"
    assert L.split_text("y" * 5000)[0]["cut_kind"] == "forced" and len(L.split_text("short")) == 1


def test_oversized_rows(spark):
    d = spark.createDataFrame([("a", "Nice day. " * 300), ("b", None), ("c", ""), ("d", "x" * 1399), ("e", "x" * 1400)], "rec_id string, text string").withColumn("piece", F.lit("clash"))
    r = L.split_oversized(d).collect()
    assert {x.rec_id: x.cut_kind for x in r} == {"a": "natural", "e": "forced"} and all(len(x.piece) == x.char_end - x.char_start for x in r)
    with pytest.raises(ValueError):
        L.split_oversized(d, limit=10, overlap=10)


def brute_leaks(docs, items, n):
    grams = {}
    for i, t in items:
        w = C.words_of(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(i, d) for d, t in docs for w in [C.words_of(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


@pytest.mark.parametrize("words", [10**6, 30])
def test_leaks_against_brute_force(spark, words):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "d,", "e-", "7"]) for _ in range(n))
    items = [(i, text(rng.randint(2, 30))) for i in range(25)] + [(90, None), (91, "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(500, items[3][1].upper().replace(" ", "\n*** ")), (501, None), (502, "")]
    d, h = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    leaks = C.find_leaks(d.withColumn("leaks", F.lit(1)), h, least=6, automaton_words=words)
    assert {(r.item_id, r.doc_id) for r in C.leaked_pairs(leaks).collect()} == brute_leaks(docs, items, 6)
    assert C.find_leaks(d.limit(0), h, least=6).count() == 0 and C.find_leaks(d, h.limit(0), least=6).count() == 0


def test_longest_runs_and_cleaning(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    doc = "Before it. One two, three four five six seven eight nine ten eleven twelve; thirteen! After it all goes on for quite some more words than that."
    a = C.Automaton([(1, item), (2, "x " + item)], 12)
    longest, spans = a.scan(C.words_of(doc))
    assert longest == {1: 13, 2: 13} and spans == [(2, 15)]
    places = C.word_places(doc)
    at = [(places[x][0], places[y - 1][1]) for x, y in spans]
    assert C.cleaned(doc, at, 24, 0.9) == (doc, 0, 13, 27)
    text, gone, _, _ = C.cleaned(doc, at, 12, 0.9)
    assert gone == 13 and text == "Before it. ! After it all goes on for quite some more words than that."


def word_count():
    @F.pandas_udf("long")
    def n(t):
        return t.fillna("").str.split().str.len().astype("int64")

    return n


def test_mixing_reaches_the_shares(spark):
    rows = [(i, "word " * (5 + i % 7), ["Big ", "BIG", "big", "small-one", "none"][i % 5] if i % 50 else None) for i in range(4000)] + [(9001, None, "big"), (9002, "  ", "big")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copy_no", F.lit("clash"))
    t = spark.createDataFrame([("big", 0.25, 1), ("small_one", 0.75, 2), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    rates = {r.source: r for r in M.source_rates(d, t, counter=word_count()).collect()}
    assert rates["small_one"].rate == 2.0 and abs(rates["big"].actual_share - 0.25) < 0.005 and rates["absent"].n_tokens == 0
    out = M.mix(d, t, counter=word_count())
    n = {r.mix_source: (r.tokens, r.most) for r in out.groupBy("mix_source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("tokens"), F.max("copy_no").alias("most")).collect()}
    assert n["small_one"] == (rates["small_one"].mixed_tokens, 2) and n["big"] == (rates["big"].mixed_tokens, 1) and set(n) == {"big", "small_one"}
    again = M.mix(d.repartition(7), t, counter=word_count())
    assert sorted(map(tuple, out.select("doc_id", "copy_no").collect())) == sorted(map(tuple, again.select("doc_id", "copy_no").collect()))
    capped = {r.source: r for r in M.source_rates(d, t, counter=word_count(), total_tokens=10.0**9).collect()}
    assert capped["big"].rate == 1.0 and capped["small_one"].rate == 2.0
    assert M.mix(d.limit(0), t, counter=word_count()).count() == 0
    M_, M.MAX_SOURCES = M.MAX_SOURCES, 2  # more targets than are broadcast
    assert sorted(map(tuple, M.mix(d, t, counter=word_count()).select("doc_id", "copy_no").collect())) == sorted(map(tuple, again.select("doc_id", "copy_no").collect()))
    M.MAX_SOURCES = M_


def test_shares_of_the_tables(spark):
    """Every source of the test tables reaches its target share as near as one hash range of it."""
    from docweft.llm.queries import QUERIES

    r = QUERIES["p7_shares"](spark, "/root/testdata/sf0.01").collect()
    assert len(r) == 12 and abs(sum(x.actual_share for x in r) - 1) < 1e-4 and all(x.rate <= x.max_repeats for x in r)
    assert all(abs(x.actual_share - x.target_share) < 0.01 for x in r), [(x.source, x.actual_share, x.target_share) for x in r]


def test_public_tokenizer_counts(spark):
    d = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    assert [r[0] for r in d.select(M.token_counter()("text")).collect()] == [2, 0, 0]


EN = ["The fee is 2.5 percent of art. 4.", "Dr. {n} signed for the parcel.", "Is the box sealed?", 'The seller said, "No refund. No swap." and left.', "Both {n} Inc. and {n} Ltd. use the yard.", "Stop now!", "iStall users pay more.", "(See clause 3 on lamps.)", "Keep the box, the label, etc. until Monday.", "Parcels weigh 3 kg max. and carry a code."]
ZH = ["您可以退回订单吗？", "卖家回复：“请寄照片。谢谢！”然后关闭了工单。", "费用是价格的2.5%。", "请保留收据……直到第5天为止。"]
HI = ["दुकान सुबह 8.30 बजे खुलती है।", "डॉ. {n} ने खाता सं. 6 की जाँच की।", "पहले भुगतान न करें!"]
TH = ["ผู้ขายต้องคืนเงินภายใน 19 วัน", "ร้าน {n} เปิดทำการทุกวัน", "สินค้าอื่น ๆ ต้องส่งคืนพร้อมกล่อง"]


def made_documents(rng, n):
    out = []
    for i in range(n):
        bank, gap = rng.choice([(EN, " "), (EN, " "), (ZH, ""), (HI, " "), (TH, " ")])
        text, ends = "", []
        for _ in range(rng.randint(1, 5)):
            text += "\n\n" if text else rng.choice(["", "  "])
            for k in range(rng.randint(1, 5)):
                s = rng.choice(bank).format(n="".join(rng.choice(x) for x in ("BCDFG", "aeiou", "klmnp", "aeiou", "rstv", "aeiou")))
                text += (gap if k else "") + s
                ends.append(len(text))
        out.append((i, text, ends))
    return out


def test_sentences_on_held_out_documents(spark):
    rng = random.Random(12)
    train, test = made_documents(rng, 2500), made_documents(rng, 500)
    schema = "doc_id bigint, text string"
    model = N.train(spark.createDataFrame([x[:2] for x in train], schema))
    d = spark.createDataFrame([x[:2] for x in test] + [(9000, None), (9001, " \n "), (None, "A. B.")], schema).withColumn("end_pos", F.lit("clash"))
    got = {(r.doc_id, r.end_pos) for r in N.sentence_ends(d, model).collect()}
    want = {(i, e) for i, _, ends in test for e in ends}
    right = len(got & want)
    assert right / len(got) > 0.97 and right / len(want) > 0.97, (right, len(got), len(want))
    assert N.sentence_ends(d.limit(0)).count() == 0


def test_units_set_off_by_blank_lines():
    m = N.BoundaryModel(N._prior(), 0.0, -1.0)
    text = "Seller fees\n\n1. Yes.\n2. It ends here \n \nPage 4 of 10"
    assert [text[:e].rsplit("\n", 1)[-1] for e in m.ends(text)] == ["Seller fees", "1. Yes.", "2. It ends here", "Page 4 of 10"]
    assert m.ends("") == [] and m.ends(" \n\n ") == []
    assert re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(text[a:b] for a, b in zip([0, *m.ends(text)], m.ends(text))))
