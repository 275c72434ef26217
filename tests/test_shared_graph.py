from minegrid.plans import registry


def _bought(spark, path):
    """Two groups of businesses, any two of a group with twelve common users, and one business with fewer."""
    rows = [(f"u{k}", b) for k in range(12) for b in ("1", "2", "3")] + [(f"w{k}", b) for k in range(12) for b in ("4", "5")] + [(f"w{k}", "6") for k in range(11)]
    spark.createDataFrame(rows, "user_id string, business_id string").write.parquet(f"{path}/small1.parquet")
    return str(path)


def test_all_graph_queries_see_the_same_graph(spark, tmp_path):
    d, q = _bought(spark, tmp_path), registry.QUERIES
    edges = {("1", "2"), ("1", "3"), ("2", "3"), ("4", "5")}
    assert {(r.u, r.v) for r in q["cooccurrence_graph"](spark, d).collect()} == edges
    assert {(r.u, r.v) for r in q["edge_betweenness"](spark, d).collect()} == edges
    comp = {r.id: r.component for r in q["connected_components"](spark, d).collect()}
    assert comp == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4"}
    assert {r.id for r in q["label_propagation"](spark, d).collect()} == set(comp) == {r.id for r in q["girvan_newman"](spark, d).collect()}
    assert "1 2 3" in {r.members for r in q["communities"](spark, d).collect()}
