from minegrid.llm import queries as Q


def test_pairs_that_occur_together_once(spark, tmp_path):
    rows = [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u2", "c")]
    spark.createDataFrame(rows, "user_id string, business_id string").write.parquet(f"{tmp_path}/small1.parquet")
    got = {(r.business_id_1, r.business_id_2): (r.m, r.n1, r.n2) for r in Q.QUERIES["p1_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (2, 2, 2), ("a", "c"): (1, 2, 1), ("b", "c"): (1, 2, 1)}
