import itertools
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minegrid.llm import distinct_runs as D
from minegrid.llm import set_join as S
from minegrid.llm.sampling import KEY, merge_samples, sample_pieces, uniform_sample, with_draw


def some_sets(rng, n):
    sets = {f"r{k}": {rng.randint(0, 60) for _ in range(rng.randint(1, 14))} for k in range(n)}
    for k in range(n):  # near copies, exact copies, a dense cluster
        s = set(sets[f"r{k}"])
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.randint(0, 60)}
        if s:
            sets[f"c{k}"] = s
    for k in range(15):
        sets[f"d{k}"] = set(range(100, 120)) - {100 + k}
    sets["e1"] = sets["e2"] = sets["e3"] = {1, 2, 3, 4, 5, 6}
    sets["giant"] = set(range(2000))
    return sets


@pytest.mark.parametrize(("num", "den", "least", "chunk"), [(1, 2, 1, 4096), (1, 2, 5, 4), (4, 5, 1, 3), (1, 4, 2, 4096), (1, 1, 1, 4096)])
def test_set_join_equals_brute_force(spark, monkeypatch, num, den, least, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "RATES", (4, 2))
    monkeypatch.setattr(S, "LARGE", 8 if chunk < 5 else 1 << 17)
    sets = some_sets(random.Random(num * 10 + den), 50)
    rows = [(f"{r} ", f" m{m}", "x") for r, s in sets.items() for m in s] + [(None, "m1", None), ("r1", None, None), (" ", "m1", None), ("r1", "", None)]
    df = spark.createDataFrame(rows + rows[:20], "id string, m string, c string")
    live = {r: s for r, s in sets.items() if len(s) >= least}
    want = {(a, b) for a, b in itertools.combinations(sorted(live), 2) if len(live[a] & live[b]) * den >= len(live[a] | live[b]) * num}
    got = [(r.id_1, r.id_2) for r in S.similar_pairs(df, "id", "m", num, den, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_set_join_of_nothing(spark):
    df = spark.createDataFrame([], "id string, m string")
    assert S.similar_pairs(df, "id", "m").count() == 0
    with pytest.raises(ValueError):
        S.similar_pairs(df, "id", "m", 0, 1)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_runs_round_trip_and_unite(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert D.decode(D.encode(x)).tolist() == sorted(a)
    assert D.union([D.encode(x), D.encode(y), D.encode(x)]).tolist() == sorted(a | b)


@pytest.mark.parametrize("target", [50_000, 20])
def test_range_counts_equal_brute_force(spark, monkeypatch, target):
    monkeypatch.setattr(D, "SLICE_TARGET", target)
    rng = random.Random(target)
    rows = [(f" u{rng.randint(0, 60)}", datetime(2020, 1, 1) + timedelta(hours=rng.randint(0, 240)), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), 1) for _ in range(400)]
    rows += [(None, datetime(2020, 1, 1), "a", "x", 1), ("  ", datetime(2020, 1, 1), "a", "x", 1), ("u1", None, "a", "x", 1)] + rows[:30]
    df = spark.createDataFrame(rows, "k string, t timestamp, g string, h string, n int")
    runs = D.build_runs(df, "k", "t", ["g", "h"])
    asks = [(date(2020, 1, i), date(2020, 1, j), g, h) for i in range(1, 11, 2) for j in range(1, 13, 3) for g in ("a", "b", D.ALL) for h in ("x", D.ALL, "nowhere")] + [(None, date(2020, 1, 1), "a", "x")]
    got = {tuple(r)[:4]: r.n for r in D.count_ranges(runs, spark.createDataFrame(asks + asks[:3], "day_from date, day_to date, g string, h string"), ["g", "h"]).collect()}
    for f, t, g, h in asks:
        want = None if f is None else len({k.strip() for k, at, x, y, _ in rows if k and k.strip() and at and f <= at.date() <= t and g in (x, D.ALL) and h in (y, D.ALL)})
        assert got[(f, t, g, h)] == want
    # parts put together count like the whole
    half = [D.build_runs(df.where(F.crc32("k") % 2 == k), "k", "t", ["g", "h"]) for k in (0, 1)]
    if target == 50_000:
        both = D.merge_runs(half[0].unionByName(half[1]), ["g", "h"]).groupBy("g", "h").agg(F.sum("n").alias("n"))
        assert {(r.g, r.h): r.n for r in both.collect()} == {(r.g, r.h): r.n for r in D.counts_by(runs, ["g", "h"]).collect()}
    assert D.build_runs(df.where("false"), "k", "t", ["g"]).count() == 0
    assert D.with_bound(spark.createDataFrame([(2**33,)], "n bigint")).first().max_error == pytest.approx(2.0)


def test_sample_is_uniform_and_merges(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("int").alias("piece"), F.lit(None).cast("string").alias("row")).repartition(9)
    hits = np.zeros(400)
    for seed in range(12):
        got = [r.id for r in uniform_sample(df, 40, ["id"], f"s{seed}").collect()]
        assert len(got) == len(set(got)) == 40
        hits[got] += 1
    assert abs(hits[:200].sum() - 240) < 60 and hits.max() <= 8
    whole = {r.id for r in uniform_sample(df, 40, ["id"], "s1").collect()}
    parts = sample_pieces(df, "piece", 40, ["id"], "s1")
    assert {r.id for r in merge_samples(parts, 40).collect()} == whole
    best = sorted((r[KEY], r.id) for r in with_draw(df, ["id"], "s1").collect())[:40]
    assert {i for _, i in best} == whole


def test_sample_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "x", None), (None, None, None)], "id bigint, row string, __draw2 string")
    assert uniform_sample(df, 10, ["id"]).count() == 4 and uniform_sample(df, 2, ["id"]).count() == 2 and uniform_sample(df, 0, ["id"]).count() == 0
    assert uniform_sample(df.where("false"), 5, ["id"]).count() == 0 and uniform_sample(df, 2, ["id"]).columns == df.columns
