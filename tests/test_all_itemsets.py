import itertools

from pyspark.sql import functions as F

from minegrid.operators import itemsets as I
from minegrid.plans import registry


def _small(spark, path):
    """25 users with the same five businesses, and 25 with one of their own beside a common one."""
    rows = [(f"{u}", f"{b}") for u in range(25) for b in range(5)] + [(f"{u}", b) for u in range(25, 50) for b in (f"{u}", "0")]
    spark.createDataFrame(rows, "user_id string, business_id string").write.parquet(f"{path}/small1.parquet")
    return str(path)


def test_sets_of_every_size(spark, tmp_path):
    d = _small(spark, tmp_path)
    want = {" ".join(c): 50 if c == ("0",) else 25 for k in range(1, 6) for c in itertools.combinations("01234", k)}
    for name in ("frequent_itemsets", "son_frequent", "frequent_by_growth"):
        assert {r["items"]: r.n for r in registry.QUERIES[name](spark, d).collect()} == want
    assert {r["items"] for r in registry.QUERIES["son_candidates"](spark, d).collect()} >= set(want)


def test_local_candidates_of_any_size_and_none(spark):
    rows = spark.createDataFrame([(f"{u}", i) for u in range(8) for i in "abcd"], "basket string, item string")
    chunk = F.pmod(F.col("basket").cast("bigint"), F.lit(2))
    assert {len(r["items"]) for r in I.local_candidates(rows, 8, chunk, None).collect()} == {1, 2, 3, 4}
    assert I.local_candidates(rows, 9, chunk, None).count() == 0 and I.local_candidates(rows.where("false"), 2, chunk, None).count() == 0


def test_second_pass_lists_only_what_begins_a_candidate(spark, monkeypatch):
    """Every basket that had one item of a candidate used to be listed with it: here 400 candidates of one common item."""
    rows = spark.range(2000).selectExpr("cast(id as string) as basket", "explode(array('a', concat('x', id % 400))) as item")
    cand = spark.range(400).selectExpr("array('a', concat('x', id)) as items").unionByName(spark.createDataFrame([(["a"],), (["b"],), (["a", "x0", "x1"],)], "items array<string>"))
    sizes, write = [], I.written
    monkeypatch.setattr(I, "written", lambda df, name, *p: (out := write(df, name, *p), sizes.append(out.count()))[0])
    assert I.count_candidates(rows, cand, 5).count() == 401 and max(sizes) <= rows.count()
    assert {tuple(r["items"]): r["n"] for r in I.count_candidates(rows, cand, 6).collect()} == {("a",): 2000}
    assert I.count_candidates(rows, cand.where("false"), 1).count() == 0
