import sys

from docweft.llm import contamination as C


def test_letters_longer_in_lower_case_shift_no_word(spark):
    item = "one two three İzmir five six seven eight"
    docs = [(1, "İİ in İstanbul: " + item.upper().replace("I", "i") + "! The end."), (2, "At İzmir and İğdır " + item), (3, "Plain. " + item.replace("İ", "i̇") + ". End")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.cleaned, r.removed_words) for r in C.find_leaks(d, spark.createDataFrame([(7, item)], "item_id bigint, text string"), least=6, max_span=6, max_coverage=0.9).collect()}
    assert got == {1: ("İİ in İstanbul: ! The end.", 9), 2: ("At İzmir and İğdır ", 9), 3: ("Plain. . End", 9)}


def test_every_letter_keeps_the_places_of_its_words():
    for c in map(chr, range(sys.maxunicode + 1)):
        if len(c.lower()) > 1 or c in "Σẞ":
            text = f"a{c} {c}b x{c}y {c}"
            places = C.word_places(text)
            assert len(places) == len(C.words_of(text)) and all(text[a:b].lower().startswith(w[:1]) for (a, b), w in zip(places, C.words_of(text)) if w[0] in "abx")
            assert all(x[1] <= y[0] for x, y in zip(places, places[1:]))
