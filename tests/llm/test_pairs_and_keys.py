import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from minegrid.llm import ledger as L
from minegrid.llm import pair_table as P
from minegrid.llm.ledger import _AS_IT_LIES, KeyLedger, judge_in_batches, settings


def brute(baskets):
    m, n = Counter(), Counter()
    for s in baskets.values():
        n.update(s)
        m.update(itertools.combinations(sorted(s), 2))
    return m, n


@pytest.mark.parametrize("block", [256, 3])
def test_signed_batches_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(block)
    t, state = P.PairTable(spark, buckets=4), {}
    for step in range(3):
        rows = [(f" u{rng.randint(0, 8)}", f"i{rng.randint(0, 9)}\t", rng.choice([1, 1, -1]) if step else 1, "x") for _ in range(60)]
        rows += [(None, "i1", 1, None), ("u1", None, 1, None), (" ", "i1", 1, None), ("u2", "", 1, None)] + rows[:5]
        df = spark.createDataFrame(rows, "u string, i string, s int, n string")
        t.apply(df, "u", "i", F.col("s"))
        sign = {}
        for u, i, s, _ in rows:
            if u and u.strip() and i and i.strip():
                sign[(u.strip(), i.strip())] = max(s, sign.get((u.strip(), i.strip()), -1))
        for (u, i), s in sign.items():
            (state.setdefault(u, set()).add if s > 0 else state.setdefault(u, set()).discard)(i)
        live = {u: s for u, s in state.items() if s}
        m, n = brute(live)
        assert {(r.item_1, r.item_2): r.m for r in t.pairs.read().collect()} == dict(m)
        assert {r.item: r.n for r in t.marginals.read().collect()} == dict(n)
        assert t.n_baskets() == len(live)
        for r in t.pairs.read().collect():  # kept scores follow every batch
            assert (r.n1, r.n2) == (n[r.item_1], n[r.item_2])
    r = t.scores().first()
    assert r.lift == pytest.approx(m[(r.item_1, r.item_2)] * len(live) / (n[r.item_1] * n[r.item_2]))


def test_empty_pair_table(spark):
    df = spark.createDataFrame([], "user string, item string")
    t = P.pair_table(df, "user", "item")
    assert t.scores().count() == 0 and t.n_baskets() == 0


def test_pair_table_goes_on_where_it_was_left(spark, tmp_path):
    path = f"file://{tmp_path}/pairs"
    cols = "u string, i string"
    P.PairTable(spark, 4, path).apply(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], cols), "u", "i")
    again = P.PairTable(spark, 8, path)
    assert again.n_baskets() == 2 and again.pairs.buckets == 4
    assert {(r.item_1, r.item_2, r.m, r.n1, r.n2) for r in again.scores().collect()} == {("x", "y", 2, 2, 2)}
    again.apply(spark.createDataFrame([("c", "x"), ("c", "y"), ("c", "z")], cols), "u", "i")
    want = {("x", "y", 3, 3, 3), ("x", "z", 1, 3, 1), ("y", "z", 1, 3, 1)}
    for t in (again, P.PairTable(spark, path=path)):
        assert t.n_baskets() == 3 and {(r.item_1, r.item_2, r.m, r.n1, r.n2) for r in t.scores().collect()} == want
    t.apply(spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], cols), "u", "i", F.lit(-1))
    assert P.PairTable(spark, path=path).n_baskets() == 2
    assert {(r.item_1, r.item_2, r.m, r.n1, r.n2) for r in t.scores().collect()} == {("x", "y", 2, 2, 2)}


def test_only_pairs_with_a_changed_item_are_made(spark):
    t = P.PairTable(spark, 4)
    t.apply(spark.createDataFrame([("a", f"{k:03d}") for k in range(100)], "u string, i string"), "u", "i")
    state = spark.createDataFrame([("a", f"{k:03d}", k != 7, True) for k in range(100)], "user string, item string, was boolean, now boolean")
    assert t._pair_deltas(state).count() == 99


SCHEMA = "n bigint, key string, bucket string, seen string"


def test_ledger_batches_ties_nulls_and_reopening(spark):
    led = KeyLedger(spark, buckets=4)
    one = spark.createDataFrame([(1, "a", None, "x"), (2, " a", None, None), (3, None, "k", None), (4, "  ", None, None), (5, "b", None, None), (5, "b", None, None), (None, "b", None, None), (None, "c", None, None)], SCHEMA)
    got = sorted(((r.n, r.key, r.seen) for r in led.judge(one, "key", "n").collect()), key=str)
    assert got == sorted([(1, "a", False), (2, " a", True), (3, None, None), (4, "  ", None), (5, "b", False), (5, "b", False), (None, "b", True), (None, "c", False)], key=str)
    again = KeyLedger(spark, led.path, buckets=4)
    two = spark.createDataFrame([(1, "a", None, None), (9, "d", None, None), (10, "d", None, None)], SCHEMA)
    assert sorted((r.n, r.seen) for r in again.judge(two, "key", "n").collect()) == [(1, True), (9, False), (10, True)]
    assert again.judge(two.where("false"), "key", "n").count() == 0


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_ledger_equals_a_set(spark, batches):
    rng = random.Random(batches)
    rows = [(k, rng.choice(["hot"] * 5 + [f"k{rng.randint(0, 40)}"]), None, None) for k in rng.sample(range(1000), 200)]
    known, want = set(), {}
    for n, k, *_ in sorted(rows, key=lambda r: r[0]):
        want[n] = k in known
        known.add(k)
    assert {r.n: r.seen for r in judge_in_batches(spark.createDataFrame(rows, SCHEMA), "key", "n", batches).collect()} == want
    assert judge_in_batches(spark.createDataFrame([], SCHEMA), "key", "n", batches).count() == 0


def test_history_is_joined_as_it_lies(spark):
    led = KeyLedger(spark, buckets=4)
    for n in range(6):
        led.judge(spark.createDataFrame([(k, f"k{k}", None, None) for k in range(30 * n, 30 * n + 40)], SCHEMA), "key", "n")
    assert led.history().count() == led.history().distinct().count() == 190 and len(led.runs) <= 4
    with settings(spark, **_AS_IT_LIES, **{"spark.sql.adaptive.enabled": "false"}):
        firsts = spark.createDataFrame([("k1", 1)], "key string, first bigint")
        plan = led.unseen(firsts)._jdf.queryExecution().executedPlan().toString()
    scans = plan.count("FileScan parquet")
    assert scans == len(led.runs) and plan.count("Bucketed: true") == scans
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # those of the batch


def test_ledger_outgrows_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_ROWS", 10)
    led = KeyLedger(spark, buckets=2)
    for n in range(3):
        led.judge(spark.createDataFrame([(k, f"k{k}", None, None) for k in range(30 * n, 30 * n + 40)], SCHEMA), "key", "n")
    again = KeyLedger(spark, led.path)
    assert again.buckets == 32 and again.history().count() == 100
    two = spark.createDataFrame([(1, "k5", None, None), (2, "new", None, None)], SCHEMA)
    assert sorted((r.n, r.seen) for r in again.judge(two, "key", "n").collect()) == [(1, True), (2, False)]
