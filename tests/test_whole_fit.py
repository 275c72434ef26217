"""Trees are fitted on every row, and alike however many tasks share the rows."""

import numpy as np
import pytest

from minegrid.operators import boosting as B


def test_trees_see_rows_beyond_any_sample(spark):
    df = spark.range(150_000).selectExpr("cast(id as double) as a", "cast(id % 2 as double) as stars")
    assert B.fit(df, ["a"], rounds=1, depth=1).base == 0.5
    odd = df.withColumn("stars", df["stars"] + (df["a"] == 149_999).cast("double") * 1e6)  # one row of all moves the mean
    assert B.fit(odd, ["a"], rounds=1, depth=1).base == pytest.approx(0.5 + 1e6 / 150_000)
    assert np.array_equal(B.fit(df, ["a"], rounds=1, depth=1).edges[0], np.quantile(np.arange(150_000.0), np.linspace(0, 1, 65)[1:-1]))


def test_tasks_side_by_side_make_the_same_trees(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(3000, 3)), 2)
    y = np.round(3 + x[:, 0] + rng.normal(size=3000))
    df = spark.createDataFrame([(float(s), *map(float, v)) for s, v in zip(y, x)], "stars double, a double, b double, c double")
    alone, three = (B.fit(df, ["a", "b", "c"], rows_a_task=n, rounds=8, depth=4, columns=0.7) for n in (3000, 1000))
    assert all(np.allclose(p, q, rtol=1e-15, atol=0) for p, q in zip(alone.edges, three.edges))
    assert all(np.array_equal(getattr(alone, k), getattr(three, k)) for k in ("feature", "border", "leaf")) and alone.base == three.base
    nine = B.fit(df.where("a > 0"), ["a", "b", "c"], n=10**9, rounds=2, depth=2)  # more tasks than rows need
    assert nine.base == pytest.approx(y[x[:, 0] > 0].mean())
