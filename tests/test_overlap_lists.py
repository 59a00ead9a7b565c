import numpy as np

from docweft.operators import overlap


def lists(docs, sets, n):
    flat = lambda of: (np.array([w for ws in of for w in ws], np.int64), np.repeat(np.arange(len(of)), [len(ws) for ws in of]))
    return sorted(zip(*(x.tolist() for x in overlap._lists(flat(docs), len(docs), flat(sets), n))))


def test_sets_with_the_same_frequent_words_are_counted_once(monkeypatch):
    most, calls = overlap._most, []
    monkeypatch.setattr(overlap, "_most", lambda *a: calls.append(1) or most(*a))
    docs, sets = [[1, 2], [1], [1, 2], [3]], [[1, 2], [1, 2, 70], [1, 2, 71], [1, 2, 72], [70]]
    assert lists(docs, sets, 2) == [(i, d, 2) for i in range(4) for d in (0, 2)]
    assert len(calls) == 1


def test_lists_of_rare_and_frequent_words_equal_all_pairs():
    rng = np.random.default_rng(3)
    word = lambda most, k: (rng.random(k) ** 4 * most).astype(int).tolist()
    docs = [word(400, 25) for _ in range(200)]  # with repeats, as of a document in several rows
    sets = [sorted(set(word(400, k))) for k in [1, 3, 5, 40] * 10] + [list(range(300))]
    got = lists(docs, sets, 4)
    shared = [[(-len(set(s) & set(d)), -i) for i, d in enumerate(docs) if set(s) & set(d)] for s in sets]
    assert got == sorted((k, -i, -c) for k, x in enumerate(shared) for c, i in sorted(x)[:4])
