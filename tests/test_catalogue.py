import importlib

import pytest


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_entry_and_contract(spark, entry):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


CORE = ["tokenize_alias_expand", "bm25_topk", "rrf_fuse", "hybrid_search_topk", "recall_mrr", "pack_sentences", "chunk_offsets", "serialise_table", "gate_report", "label_review", "layer_a_verdict", "stream_ingest_dedup"]


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, entry, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    import glob
    import os

    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = entry.queries()[name](spark, d), con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_nothing_outside_imports_the_training_subpackage():
    from pathlib import Path

    root = Path(importlib.import_module("docweft").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "docweft.llm" not in p.read_text(), p
