from docweft.operators import fusion, lexical
from docweft.plans.queries import QUERIES


def test_hybrid_search_ranks_what_has_no_vector(spark, tmp_path):
    chunks = [(0, "alpha beta", "a", 1), (1, "gamma delta", "a", 2), (7, "omega omega", "b", 1), (8, "omega sigma", "b", 2)]  # 7 and 8 have no vector
    spark.createDataFrame(chunks, "chunk_pos bigint, text string, doc string, page int").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = [("q0", "omega"), ("q8", "sigma")]  # q8 has no vector, so chunk 8 is not its own
    spark.createDataFrame(asked, "id string, question string").write.parquet(f"{tmp_path}/questions_sme_v3.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = QUERIES["hybrid_search_topk"](spark, str(tmp_path)).collect()
    got = {(r.query_id, r.chunk_pos): (r.bm25_rank, r.dense_place, r.doc) for r in hits}
    assert got == {("q0", 7): (1, None, "b"), ("q0", 8): (2, None, "b"), ("q0", 1): (None, 1, "a"), ("q8", 8): (1, None, "b")}
    considered = QUERIES["search_hits_considered"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.chunk_pos) for r in considered} == set(got)


def test_an_excluded_chunk_takes_no_place_in_the_lexical_list(spark):
    c = spark.createDataFrame([(0, "alpha"), (1, "alpha"), (2, "alpha beta"), (3, "gamma")], "chunk_pos bigint, text string")
    v = spark.createDataFrame([(3, [1.0, 0.0])], "chunk_pos bigint, vec array<float>")
    q = spark.createDataFrame([("own", "alpha", [1.0, 0.0], 0), ("none", "alpha", None, None)], "query_id string, question string, qvec array<float>, own bigint")
    r = fusion.hybrid_search(q, lexical.build(c), v, c, depth=2, exclude="own").where("bm25_rank is not null").collect()
    assert {(x.query_id, x.bm25_rank): x.chunk_pos for x in r} == {("own", 1): 1, ("own", 2): 2, ("none", 1): 0, ("none", 2): 1}
