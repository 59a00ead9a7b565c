import pytest

from docweft.operators import labels, overlap

QUESTIONS = [("a", "brass lamps cost nine crowns"), ("b", "wool bags"), ("b", "wool hats"), ("c", "the of"), ("d", None)]
CHUNKS = [(1, "Brass lamps"), (1, "brass bowls"), (2, "lamps cost"), (3, "brass lamps cost"), (4, "wool hats and bags"), (5, None), (6, "lamps, brass")]


def ranked(spark, weak, n=2):
    q, c = spark.createDataFrame(QUESTIONS, "id string, answer string"), spark.createDataFrame(CHUNKS, "chunk_pos bigint, text string")
    d = labels.answer_candidates(q, c, n, weak=weak)
    return d, sorted((r.id, r.place, r.chunk_pos, r.overlap) for r in d.collect())


def one_block_of_pairs(d):
    """Documents and questions meet in blocks, not as a row per shared word."""
    return "FlatMapCoGroupsInArrow" in d._jdf.queryExecution().executedPlan().toString()


def test_weak_candidates_count_a_word_of_a_chunk_once(spark):
    d, got = ranked(spark, True)
    assert got == [("a", 1, 3, 3), ("a", 2, 6, 2), ("b", 1, 4, 3)]
    assert one_block_of_pairs(d)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_best_overlaps_equal_all_pairs(spark, block):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(sorted({rng.choice(words[: rng.choice([5, 300])]) for _ in range(12)}))) for i in range(60)]
    want = {f"q{i}": {rng.choice(words) for _ in range(rng.choice([3, 290]))} for i in range(25)}
    d = spark.createDataFrame(docs, "chunk_pos bigint, text string").withColumn("w", F.split("text", " "))
    got = overlap.most_shared(spark.createDataFrame([(k, x) for k, v in want.items() for x in v], "id string, tok string"), d, 4, "id", "chunk_pos", "text", "w", doc_block=block)
    best = {k: sorted(((-len(v & set(t.split())), -i) for i, t in docs if v & set(t.split())))[:4] for k, v in want.items()}
    assert sorted((r.id, r.place, -r.overlap, -r.chunk_pos) for r in got.collect()) == sorted((k, p, *x) for k, v in best.items() for p, x in enumerate(v, 1))


def test_answer_candidates_count_a_word_of_a_question_once(spark):
    d, got = ranked(spark, False)
    assert got == [("a", 1, 3, 3), ("a", 2, 6, 2), ("b", 1, 4, 3)]
    assert one_block_of_pairs(d)


def test_label_review_ranks_other_chunks_by_blocks(spark):
    q = spark.createDataFrame([("a", "brass lamps", [2], None), ("a", "brass lamps cost", [2], None), ("b", "wool hats", [4], None), ("c", "iron hooks", [9], None)], "id string, answer string, gold_chunks array<bigint>, matched_span string")
    d = labels.label_review(q, spark.createDataFrame([(1, "Brass lamps"), (2, None), *CHUNKS[3:], (7, "lots of wool hats")], "chunk_pos bigint, text string"))
    assert [(r.id, r.why, r.best_other, r.n_other) for r in d.collect()] == [("a", "other_chunk", 3, 3)]
    assert one_block_of_pairs(d)
