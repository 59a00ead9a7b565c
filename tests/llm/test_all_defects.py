from docweft.llm import pair_defects as P


def test_an_answer_with_two_defects_has_both(spark):
    rows = [(0, "According to the documents the fee is due at the"), (1, "Laut den Unterlagen nimmt die Firma den Antrag innerhalb von 3 Tagen an,"), (2, "I don't know, the documents say nothing about the"),
            (3, "What fee is due at the hub? A:"), (4, "I don't know."), (5, None)]
    d = spark.createDataFrame([(i, "What fee is due at the hub?", a, "12 per week") for i, a in rows], "answer_id bigint, question string, answer string, gold_answer string")
    got = {r.answer_id: (r.main, list(r.defects)) for r in P.pair_defects(d).collect()}
    assert got == {0: ("truncated", ["truncated"]), 1: ("other_language", ["other_language", "truncated"]), 2: ("refusal", ["refusal", "truncated"]),
                   3: ("copies_question", ["copies_question", "truncated"]), 4: ("refusal", ["refusal"]), 5: ("empty", ["empty"])}
