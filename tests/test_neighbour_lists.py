"""Neighbours come from raters' lists, not from a look-up of the raters of every pair; both ways give the same."""

import random

import pytest
from pyspark.sql import functions as F

from minegrid.operators import recommend as R


def _rows(spark, seed):
    rng = random.Random(seed)
    train = {(f"u{rng.randint(1, 40)}", f"i{int(rng.paretovariate(0.7)) % 30}"): float(rng.randint(1, 5)) for _ in range(500)}
    test = {(f"u{rng.randint(1, 45)}", f"i{rng.randint(0, 33)}") for _ in range(120)}
    return spark.createDataFrame([(*k, s) for k, s in train.items()], "user string, item string, stars double"), spark.createDataFrame(sorted(test), "user string, item string")


@pytest.mark.parametrize("entries", [50, 250_000])
def test_lists_and_look_ups_agree(spark, monkeypatch, entries):
    monkeypatch.setattr(R, "ENTRIES", entries)
    train, test = _rows(spark, entries)
    items, t, dev = R._coded(train, test)
    lists, looks = ({(r.q, r.code): (r.stars, round(r.sim, 8), r["rank"]) for r in R._near(t, dev, 5, cost).collect()} for cost in (0.0, 1e9))
    assert lists == looks and len(lists) > 100
    sim = R.item_similarity(train)
    both = sim.select("i", "j", "sim").union(sim.select("j", "i", "sim")).toDF("item", "other", "sim")
    want = test.join(train.select("user", F.col("item").alias("other")), "user").where("item != other").join(both, ["item", "other"]).count()
    assert R.neighbours(train, test, 10**6).count() == want


def test_what_neighbours_write_follows_the_co_ratings(spark, monkeypatch):
    """Two popular items, many wanted pairs with them: the raters of each pair used to be looked up anew."""
    seen = []
    monkeypatch.setattr(R, "item_similarity", lambda *a, **k: seen.append(a))
    train = spark.createDataFrame([(f"u{k}", i, float(1 + k % 5)) for k in range(300) for i in ("a", "b", f"x{k % 20}")], "user string, item string, stars double")
    assert R.neighbours(train, train.select("user", "item"), 20).count() == 1800 and not seen
