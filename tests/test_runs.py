import random

from docweft.operators import labels
from docweft.operators.runs import longest_runs


def brute(texts, answer):
    w = answer.split(" ")
    for s in range(len(w) - 3):
        for e in range(len(w), s + 3, -1):
            if hits := [i for i, t in enumerate(texts) if " ".join(w[s:e]) in t]:
                yield s, e - s, min(4, len(hits)), hits if len(hits) < 4 else None
                break


def test_longest_runs_equal_substring_search():
    for seed in range(60):
        rng = random.Random(seed)
        words = ["a", "ab", "b", "cab", "ca", "d1", "bca"][: rng.randint(2, 7)]
        text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
        texts, answers = [text(14) for _ in range(rng.randint(1, 12))], [text(9) for _ in range(12)]
        got = sorted((a, s, z, n, sorted(f) if n < 4 else None) for a, s, z, n, f in ((*x, [i for i in f if i >= 0]) for *x, f in zip(*(v.tolist() for v in longest_runs(texts, answers, 4, 3)))))
        assert got == sorted((i, *x) for i, a in enumerate(answers) for x in brute(texts, a))
    assert not len(longest_runs([], ["a b c d"], 4, 3)[0]) and not len(longest_runs(["x"], ["a b c d"], 4, 3)[0])


def test_long_answers_cost_their_length_and_rows_count_as_they_come(spark):
    # 600 words have 180 000 runs, of which one per start is counted
    long = " ".join(f"w{i}" for i in range(600))
    texts = [(1, "x " + long), (2, "some w7 w8 w9 w10 then"), (3, "a b c d"), (3, "z a b c d"), (4, "a b c d e"), (5, "e a b c d")]
    answers = [("long", long), ("common", "a b c d"), ("rare", "a b c d e")]
    d = labels.verbatim_labels(spark.createDataFrame(answers, "id string, answer string"), spark.createDataFrame(texts, "chunk_pos bigint, text string"))
    assert {r.id: (r.span, r.chunks) for r in d.collect()} == {"long": (long, [1]), "rare": ("a b c d e", [4])}
    assert "FlatMapCoGroupsInArrow" in d._jdf.queryExecution().executedPlan().toString()
