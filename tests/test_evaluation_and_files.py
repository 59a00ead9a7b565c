import json

import pytest
from pyspark.sql import functions as F

from docweft import cli
from docweft.engine import EmptyIndex, Engine
from docweft.operators import dense, evaluation, grading, labels
from docweft.operators.gates import GateError
from docweft.operators.index import ChunkIndex, ConflictError
from docweft.sources import files, models
from docweft.streaming import ingest

Q = "query_id string, gold_chunks array<bigint>, stratum string"


def test_first_rank_recall_and_empty(spark):
    q = spark.createDataFrame([("a", [1, 2], "x"), ("b", [9], "x"), ("c", [], "y")], Q)
    r = spark.createDataFrame([("a", 5, 1), ("a", 2, 2), ("b", 1, 1)], "query_id string, chunk_pos bigint, rank int")
    ranks = evaluation.first_gold_rank(r, q, keep=("stratum",))
    assert {x.query_id: x.first_rank for x in ranks.collect()} == {"a": 2, "b": None, "c": None}
    m = evaluation.recall_mrr(ranks).first()
    assert (m.n_questions, m.recall_at_1, m.recall_at_3, m.mrr) == (3, 0.0, pytest.approx(1 / 3, abs=1e-6), pytest.approx(1 / 6, abs=1e-6))
    assert evaluation.recall_mrr(ranks.limit(0)).first().n_questions == 0


def metrics(spark, rows):
    return spark.createDataFrame(rows, "retriever string, recall_at_1 double, recall_at_3 double, recall_at_5 double, recall_at_10 double, mrr double")


def test_verdict_prefers_who_never_regresses(spark):
    rows = [("base", 0.5, 0.7, 0.8, 0.9, 0.6), ("risky", 0.9, 0.6, 0.8, 0.9, 0.7), ("safe", 0.6, 0.7, 0.8, 0.9, 0.65)]
    v = evaluation.verdict(metrics(spark, rows), "base").first()
    assert (v.retriever, v.never_worse) == ("safe", True)
    v = evaluation.verdict(metrics(spark, rows[:2]), "base").first()
    assert (v.retriever, v.never_worse) == ("risky", False)


def test_stats_block_ignores_nulls(spark):
    d = spark.createDataFrame([(1.0,), (None,), (4.0,), (10.0,)], "v double")
    assert tuple(evaluation.stats_block(d, "v").first()) == (3, 5.0, 4.0, 1.0, 10.0)


def test_tristate_hits(spark):
    q = spark.createDataFrame([("a", [1], ""), ("b", [7], ""), ("c", [], "")], Q)
    got = spark.createDataFrame([("a", "s:1")], "query_id string, chunk_id string")
    m = spark.createDataFrame([(1, "s:1")], "chunk_pos bigint, chunk_id string")
    assert {r.query_id: (r.hit, r.n_unmapped) for r in evaluation.gold_map_hits(q, got, m).collect()} == {"a": (True, 0), "b": (None, 1), "c": (None, 0)}


CHUNKS = [(0, "the fee is 48,555 per week at the hub"), (1, "write to info@shop.example before noon"), (2, "nothing here")]


def brute_verbatim(answer, chunks):
    import re

    def norm(x):
        return " ".join(re.sub(r"[^a-z0-9@.+]", " ", x.lower()).split())

    w = norm(answer).split()
    runs = sorted(((a, b) for a in range(len(w)) for b in range(a + 4, len(w) + 1)), key=lambda r: (r[0] - r[1], r[0]))
    proofs = ((s, [i for i, t in chunks if s in norm(t)]) for s in (" ".join(w[a:b]) for a, b in runs))
    return next(((s, hits) for s, hits in proofs if 1 <= len(hits) <= 3), None)


def test_labels_by_proof(spark):
    c = spark.createDataFrame(CHUNKS, "chunk_pos bigint, text string")
    q = spark.createDataFrame([("v", "fee is 48,555 per we"), ("a", "mail info@shop.example"), ("n", "some other words entirely"), ("z", None), ("e", "")], "id string, answer string")
    got = {r.id: (r.tier, r.matched) for r in labels.autolabel(q, c).collect()}
    assert got == {"v": ("VERBATIM", "fee is 48 555 per we"), "a": ("ANCHOR", "info@shop.example"), "n": ("ABSTAIN", ""), "z": ("ABSTAIN", ""), "e": ("ABSTAIN", "")}


def test_verbatim_equals_the_sequential_rule(spark):
    import random

    rng = random.Random(2)
    words = ["a", "ab", "b", "cab", "ca", "d1"]
    chunks = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(30)]
    answers = [(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(3, 8)))) for i in range(40)]
    got = {r.id: (r.span, r.chunks) for r in labels.verbatim_labels(spark.createDataFrame(answers, "id string, answer string"), spark.createDataFrame(chunks, "chunk_pos bigint, text string")).collect()}
    assert got == {k: v for k, a in answers if (v := brute_verbatim(a, chunks))}


def test_layer_a(spark):
    c = spark.createDataFrame(CHUNKS, "chunk_pos bigint, text string")
    a = spark.createDataFrame([(1, "The fee is 48,555 per week", [0]), (2, "NOT_IN_DOCUMENTS", [0]), (3, "not_in_documents", []), (4, "Bananas grow elsewhere", [0]), (5, None, None)], "answer_id bigint, answer string, gold_chunks array<bigint>")
    assert {r.answer_id: r.a_verdict for r in grading.layer_a(a, c).collect()} == {1: "PASS", 2: "FAIL", 3: "PASS", 4: "FAIL", 5: "FAIL"}


def test_judge_replies(spark):
    raw = ['ok {"verdict": "FAITHFUL", "evidence": "x", "reason": "y"} end', "no braces", "{broken"]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i").select(grading.parse_judge(F.col("r")).alias("j"))
    assert [r.j.verdict for r in d.collect()] == ["FAITHFUL", "PARSE_ERROR", "PARSE_ERROR"]


def test_tokens_per_second_guards(spark):
    d = spark.createDataFrame([(10, 2_000_000_000), (0, 5), (5, 0), (None, 5)], "c bigint, n bigint")
    assert [r.t for r in d.select(grading.tokens_per_second(F.col("c"), F.col("n")).alias("t")).collect()] == [5.0, None, None, None]


def test_dump_round_trip(spark, tmp_path):
    c = spark.createDataFrame([(0, "a.txt", "clause", 1, "Head\nbody ends in a blank "), (1, "b.txt", "table", None, "x | y: 1\n\nz")], "chunk_pos bigint, doc string, kind string, page int, text string")
    p = str(tmp_path / "dump.txt")
    stamp = files.write_dump(c, p)
    back = files.read_dump(spark, p).orderBy("chunk_pos").collect()
    assert [(r.doc, r.text) for r in back] == [("a.txt", "Head\nbody ends in a blank "), ("b.txt", "x | y: 1\n\nz")]
    assert files.read_stamp(spark, p) == stamp and files.read_dump(spark, p, "a.txt").count() == 1
    text = open(p).read().replace("blank \n", "blank\n")
    open(p, "w").write(text)
    with pytest.raises(GateError):
        files.read_dump(spark, p)


def test_questions_gold_map_and_jsonl(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"q{n}.json").write_text(json.dumps({"_meta": {"x": "y"}, "questions": [{"id": f"Q{n}", "question": "?", "gold_chunks": [n], "_evidence": {"tier": "ANCHOR", "matched": "m"}}]}))
    q = files.read_questions(spark, [str(tmp_path / "q1.json"), str(tmp_path / "q2.json")]).orderBy("file_no").collect()
    assert [(r.id, r.gold_chunks, r.evidence.tier) for r in q] == [("Q1", [1], "ANCHOR"), ("Q2", [2], "ANCHOR")]
    (tmp_path / "map.json").write_text('{"0": "ab:0", "1": "ab:1"}')
    assert files.read_gold_map(spark, str(tmp_path / "map.json")).count() == 2
    (tmp_path / "r.jsonl").write_text('{"id": "a"}\n\n{"id": \n')
    assert files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id string", lenient=True).count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id string").collect()


PACKET = "### Q01 — prose\n**Layer A verdict:** PASS\n[x] CORRECT\n[ ] UNGROUNDED\n[ ] WRONG\n[ ] LABEL ISSUE\n"


def test_packets(spark, tmp_path):
    def read(text):
        (tmp_path / "packet.md").write_text(text)
        return [tuple(r) for r in files.read_packet(spark, str(tmp_path / "packet.md")).collect()]

    second = PACKET.replace("Q01 — prose", "Q02 — near_miss").replace("[x]", "[ ]").replace("[ ] WRONG", "[X] WRONG")
    assert read("# Review\n" + PACKET + "\n" + second) == [("Q01", "prose", "PASS", "CORRECT"), ("Q02", "near_miss", "PASS", "WRONG")]
    for bad in ("", PACKET.replace("[x]", "[ ]"), PACKET.replace("[ ] WRONG", "[x] WRONG"), PACKET.replace("[ ] WRONG\n", ""), PACKET.replace("**Layer A verdict:** PASS\n", "")):
        with pytest.raises(ValueError):
            read(bad)


DOC = "sha256 string, filename string, pages int, chunks array<struct<page:int,char_start:bigint,char_end:bigint,text:string,n_tokens:int>>"


def docs(spark, *names):
    return spark.createDataFrame([(n * 16, f"{n}.pdf", 1, [(1, 0, 5, f"{n} sells lamps", 4), (1, 6, 9, f"{n} ships late", 4)]) for n in names], DOC)


def test_index_appends_once_and_searches(spark, tmp_path):
    root, enc = str(tmp_path / "ix"), dense.HashingEncoder()
    ix = ChunkIndex.open(spark, root)
    assert ix.empty and ix.stats()["n_chunks"] == 0
    assert ix.append(docs(spark, "aaaa", "bbbb"), enc) == 1
    assert ix.append(docs(spark, "aaaa"), enc) == 0
    assert ix.append(docs(spark, "aaaa", "cccc"), enc) == 1
    ix = ChunkIndex.open(spark, root)
    assert ix.stats()["n_documents"] == 3 and ix.has_document("cccc" * 4 + "") is False and ix.has_document("cccc" * 16) is True
    q = spark.createDataFrame([("q", "who ships late")], "query_id string, question string")
    r = ix.search(q, 2, enc).orderBy("place").collect()
    assert r[0].text.endswith("ships late") and {x.slot for x in r} == {"hit", "considered"}
    assert all(x.dense_place is None for x in ix.search(q, 2).collect())
    with pytest.raises(GateError):
        ix.search(q, 2, dense.HashingEncoder(model_id="other"))


def test_crash_before_commit_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "ix")
    ix = ChunkIndex.open(spark, root)
    ix.append(docs(spark, "aaaa"))

    def crash():
        raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        ix.append(docs(spark, "bbbb"), before_commit=crash)
    ix = ChunkIndex.open(spark, root)
    assert ix.stats()["n_documents"] == 1 and ix.table("chunks").count() == 2
    assert ix.vacuum() and ix.append(docs(spark, "bbbb")) == 1


def test_two_writers_conflict(spark, tmp_path):
    root = str(tmp_path / "ix")
    a, b = ChunkIndex.open(spark, root), ChunkIndex.open(spark, root)
    a.append(docs(spark, "aaaa"))
    with pytest.raises(ConflictError):
        b.append(docs(spark, "bbbb"))


def test_engine_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "terms.txt").write_text("Seller terms\n1. Fees Sellers pay ten percent. 2. Returns Goods come back within nine days.\fPage 2 of 2\nOrders ship on Monday.")
    root = str(tmp_path / "ix")
    with pytest.raises(EmptyIndex):
        Engine(spark, root).answers(spark.createDataFrame([("q", "x")], "query_id string, question string"))
    assert cli.main(["--index-dir", root, "ask", "anything"], spark) == 3
    assert cli.main(["ingest", str(tmp_path / "missing.txt"), "--index-dir", root], spark) == 2
    assert cli.main(["ingest", str(tmp_path / "terms.txt"), "--index-dir", root], spark) == 0
    assert cli.main(["ingest", str(tmp_path / "terms.txt"), "--index-dir", root], spark) == 0
    assert cli.main(["--index-dir", root, "ask", "When do goods come back?", "-k", "1"], spark) == 0
    out = capsys.readouterr().out
    assert "1 of 1 documents are new" in out and "0 of 1 documents are new" in out and "nine days" in out and "terms.txt" in out


def test_paths(tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"")
    assert files.expand_paths([str(tmp_path), str(tmp_path / "a.pdf")]) == [str((tmp_path / "a.pdf").resolve())]
    for bad in ([str(tmp_path / "no.pdf")], [__file__], [str(tmp_path.parent / "nothing")]):
        with pytest.raises((FileNotFoundError, ValueError)):
            files.expand_paths(bad)


def test_stream_appends_each_document_once(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "ix")
    docs(spark, "aaaa", "bbbb").write.parquet(src)
    seen = []
    for _ in range(2):
        s = ingest.read_documents(spark, src, docs(spark, "x").schema)
        ingest.ingest_stream(s, root, str(tmp_path / "progress"), on_batch=lambda i, n: seen.append(n)).awaitTermination()
        docs(spark, "bbbb", "cccc").write.mode("append").parquet(src)
    assert ChunkIndex.open(spark, root).stats()["n_documents"] == 3 and sum(seen) == 2


def test_peak_memory(spark):
    assert models.peak_memory_mb() > 1 and models.peak_memory_mb(2**30) is None
    assert "driver" in models.executor_peaks(spark)

def test_encoder_prefixes():
    assert dense.prefix_for("intfloat/e5-small-v2") == ("query: ", "passage: ") and dense.prefix_for("other") == ("", "")


def test_reports(spark, tmp_path):
    from docweft.sources.reports import write_report

    p = str(tmp_path / "r.md")
    write_report(p, "Run", {"Counts": spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string"), "Note": "text"})
    assert open(p).read() == "# Run\n\n## Counts\n\n| n | s |\n|---|---|\n| 1 | a/b |\n| 2 |  |\n\n## Note\n\ntext\n"


class Counting:
    def counted(self, system, user):
        return f"{len(user)} letters", 12, 3_000_000_000


def test_counters_of_completions(spark):
    d = spark.createDataFrame([(1, "s", "abc")], "k int, system string, user string")
    assert [tuple(r)[:2] + tuple(r)[3:] for r in models.complete_all(d, Counting, "k").collect()] == [(1, "3 letters", 12, 3_000_000_000)]
    r = models.complete_all(d, models.EchoClient, "k").first()
    assert r.reply == "NOT_IN_DOCUMENTS" and r.n_tokens is None


def test_probes_that_no_chunk_answers(spark):
    asked = spark.createDataFrame([("Is there a yard in Nowhere?", "no yard named", ["Nowhere"]), ("When does the shop open?", "", ["shop", "open"]), ("Empty?", "", [])], "question string, why_absent string, telling array<string>")
    chunks = spark.createDataFrame([(1, "The shop does open at nine."), (2, None)], "chunk_pos int, text string")
    r = labels.abstention_probes(asked, chunks, "by hand").collect()
    assert [(x.id, x.question, x.gold_chunks, x.stratum) for x in r] == [("U01", "Is there a yard in Nowhere?", [], "unanswerable")]


def test_lost_rows_and_mixed_appends(spark, tmp_path):
    import shutil

    root, enc = str(tmp_path / "ix"), dense.HashingEncoder()
    q = spark.createDataFrame([("q", "who ships late")], "query_id string, question string")
    ix = ChunkIndex.open(spark, root)
    assert ix.search(q, 2, enc).count() == 0 and ix.search(q, 2).count() == 0 and set(ix.timings(q)) == {"total"}
    ix.append(docs(spark, "aaaa"), enc)
    with pytest.raises(GateError):
        ix.append(docs(spark, "bbbb"))
    ix.append(docs(spark, "bbbb", "cccc"), enc)
    want = sorted(map(tuple, ix.search(q, 3, enc).select("chunk_id", "place", "slot", "rrf_score").collect()))
    for t in ("postings", "terms", "documents"):
        shutil.rmtree(f"{root}/{t}/batch={ix.manifest.batches[0]}")
    ix = ChunkIndex.open(spark, root)
    assert sorted(map(tuple, ix.search(q, 3, enc).select("chunk_id", "place", "slot", "rrf_score").collect())) == want
    ix.compact()
    assert len(ix.vacuum()) == 10 and len(ChunkIndex.open(spark, root).manifest.batches) == 1
    ix = ChunkIndex.open(spark, root)
    assert sorted(map(tuple, ix.search(q, 3, enc).select("chunk_id", "place", "slot", "rrf_score").collect())) == want and set(ix.timings(q, 3, enc)) == {"bm25", "dense", "total"}
    (tmp_path / "ix" / "manifest-000000000009.json").write_text("{")  # a writer that was stopped
    assert ChunkIndex.open(spark, root).manifest.version == 3
    shutil.rmtree(f"{root}/embeddings/batch={ix.manifest.batches[0]}")
    with pytest.raises(GateError):
        ChunkIndex.open(spark, root)
    plain = ChunkIndex.open(spark, str(tmp_path / "plain"))
    plain.append(docs(spark, "aaaa"))
    with pytest.raises(GateError):
        plain.append(docs(spark, "bbbb"), enc)


def test_models():
    assert models.EchoClient().complete("", "[1] first\n\n[2] second") == "first"
    with pytest.raises(models.ModelMissing):
        models.HttpClient("http://127.0.0.1:9", "m", timeout=1).complete("", "")
