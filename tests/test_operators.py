import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minegrid.functions import scalars as fn
from minegrid.operators import clustering as C
from minegrid.operators import graph as G
from minegrid.operators import itemsets as I
from minegrid.operators import recommend as R
from minegrid.operators import relational as rel
from minegrid.operators import similarity as S


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ab", "2010-01-02", "a,b,c", {"P": "2", "W": "True", "X": "False"}), ("", "none", "None", {"P": "x"}), ("é", None, None, None)], "s string, y string, l string, m map<string,string>")
    got = df.select(fn.bytes_mod(F.col("s"), 1009).alias("h"), fn.years_until(F.col("y")).alias("y"), fn.list_length(F.col("l")).alias("n"), fn.number_at(F.col("m"), "P").alias("p"), fn.attribute_score(F.col("m"), ["P", "W", "X"]).alias("a")).collect()
    assert [r.h for r in got] == [int.from_bytes(s.encode(), "big") % 1009 for s in ("ab", "", "é")]
    assert [r.y for r in got] == [13, None, None] and [r.n for r in got] == [3, 1, 0] and [r.p for r in got] == [2.0, 0.0, 0.0] and [r.a for r in got] == [2, 1, 0]
    z = spark.createDataFrame([(0,), (1,), (8,), (12,)], "h bigint").select(fn.trailing_zeros(F.col("h")).alias("t")).collect()
    assert [r.t for r in z] == [3, 0, 3, 2]


def test_relational(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("",)], "t string")
    assert {tuple(r) for r in rel.word_count(df, "t").collect()} == {("a", 2), ("b", 1), ("", 1)}
    k = spark.createDataFrame([(c, v) for c, v in [("b", 1.0), ("a", 3.0), ("a", 2.0), (None, 9.0), ("c", None)]], "k string, v double")
    assert [r.k for r in rel.top_k(k, "k", 2).collect()] == ["a", "b"]
    idx = rel.dense_index(spark.range(1000).withColumn("x", F.md5(F.col("id").cast("string"))), "x").orderBy("idx").collect()
    assert [r.idx for r in idx] == list(range(1000)) and [r.x for r in idx] == sorted(r.x for r in idx)
    assert rel.dense_index(k.where("false"), "k").count() == 0
    assert rel.laid_out(k, "k", 3).rdd.getNumPartitions() == 3
    t = spark.createDataFrame([(1.0, 1.5), (2.0, 6.5), (3.0, 3.0)], "p double, s double")
    assert {tuple(r) for r in rel.error_histogram(t, "p", "s").collect()} == {(0, 2), (4, 1)}
    assert rel.precision_recall(spark.range(4), spark.range(2, 8), ["id"]).first()[2:] == (2, 0.5, 2 / 6)
    lab = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (1, 2)], "a int, b int")
    assert rel.mutual_information(lab, "a", "b").first()["nmi"] == 1.0
    assert [r.v for r in rel.zscores(k.where("v is not null").select("v"), ["v"]).orderBy("v").collect()][0] < 0


@pytest.mark.parametrize("seed", [1, 2])
def test_itemsets_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bask = {f"b{k}": {str(rng.randint(1, 9)) for _ in range(rng.randint(1, 7))} for k in range(40)}
    raw = [(b, i) for b, s in bask.items() for i in s for _ in range(rng.randint(1, 2))] + [(None, "1"), ("b1", None), (" ", "2"), ("b2", " ")]
    rows = I.baskets(spark.createDataFrame(raw, "b string, i string"), "b", "i")
    want = {}
    for n in range(1, 8):
        for c in itertools.combinations(sorted({i for s in bask.values() for i in s}), n):
            m = sum(set(c) <= s for s in bask.values())
            if m >= 5:
                want[c] = m
    assert {tuple(r["items"]): r["n"] for r in I.frequent_itemsets(rows, 5).collect()} == want
    assert {tuple(r["items"]): r["n"] for r in I.frequent_by_growth(rows, 5).collect()} == want
    cand = I.local_candidates(rows, 5, F.pmod(F.substring("basket", 2, 9).cast("int"), F.lit(3)), 3)
    assert {tuple(r["items"]): r["n"] for r in I.count_candidates(rows, cand, 5).collect()} == {k: v for k, v in want.items() if len(k) <= 3}
    assert I.frequent_itemsets(rows.where("false"), 2).count() == 0 and I.frequent_by_growth(rows.where("false"), 2).count() == 0


def test_lsh_is_a_subset_of_the_exact_join(spark):
    rng = random.Random(5)
    sets = {f"r{k}": {rng.randint(0, 300) for _ in range(12)} for k in range(60)}
    for k in range(20):
        sets[f"c{k}"] = set(list(sets[f"r{k}"])[: 8 + k % 5]) | {1000 + k}
    df = spark.createDataFrame([(r, str(m)) for r, s in sets.items() for m in s], "r string, m string")
    exact = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in S.lsh_similar(df, "r", "m").collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact)
    assert S.lsh_similar(df.where("false"), "r", "m").count() == 0


def test_item_cf_decisions(spark):
    train = spark.createDataFrame([("u1", "i1", 5.0), ("u1", "i2", 3.0), ("u2", "i1", 4.0), ("u2", "i2", 1.0), ("u3", "i3", 2.0)], "user string, item string, stars double")
    test = spark.createDataFrame([("u1", "new"), ("new", "i1"), ("new", "new"), ("u3", "i3"), ("u3", "i1"), ("u1", "i1"), ("u1", "i1")], "user string, item string")
    got = {(r.user, r.item): r.prediction for r in R.item_cf(train, test).collect()}
    assert got[("u1", "new")] == 4.0 and got[("new", "i1")] == 4.5 and got[("new", "new")] == 3.0 and got[("u3", "i3")] == 2.0 and got[("u3", "i1")] == 3.25
    assert got[("u1", "i1")] == pytest.approx(0.1 * 3 * 1 + 0.5 * 4.5 + 0.4 * 4) and len(got) == 6


def test_trees_blend_and_elimination(spark):
    rng = random.Random(0)
    rows = [(f"u{k}", f"i{k}", x, y, 2 * x + 0.1 * y) for k in range(200) for x, y in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(rows, "user string, item string, x double, noise double, stars double")
    m = R.predict_trees(R.fit_trees(df, ["x", "noise"], rounds=5, depth=3), df)
    zero = df.select("user", "item", F.lit(0.0).alias("prediction"))
    grid = R.search_blend(m, zero, df).collect()
    assert len(grid) == 20 and grid[0].weight == pytest.approx(1.0)
    direct = R.blend(m, zero, grid[3].weight).join(df, ["user", "item"]).select(F.sqrt(F.avg((F.col("prediction") - F.col("stars")) ** 2))).first()[0]
    assert grid[3].rmse == pytest.approx(direct, rel=1e-6)
    rounds = R.eliminate(df, df, ["x", "noise"], rounds=3, depth=2)
    assert rounds[-1][0] == ["x"]
    assert R.tune(df, ["x"], {"maxDepth": [1, 2], "maxIter": [2]}, folds=2).bestModel is not None


def brute_betweenness(edges):
    adj = {}
    for u, v in edges:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    out = dict.fromkeys(edges, 0.0)

    def paths(s, t):
        level, found = [[s]], []
        seen = {s}
        while level and not found:
            nxt = [p + [y] for p in level for y in adj[p[-1]] if y not in seen]
            seen |= {p[-1] for p in nxt}
            found = [p for p in nxt if p[-1] == t]
            level = nxt
        return found

    for s, t in itertools.combinations(sorted(adj), 2):
        ps = paths(s, t)
        for p in ps:
            for a, b in zip(p, p[1:]):
                out[(min(a, b), max(a, b))] += 1 / len(ps)
    return {e: round(x, 5) for e, x in out.items()}


def brute_split(edges):
    """Cut the edges of greatest betweenness until none is left; the parts with the best modularity."""
    nodes, m = sorted({x for e in edges for x in e}), len(edges)
    degree = {x: sum(x in e for e in edges) for x in nodes}
    left, best, best_q = list(edges), None, -1.0
    while left:
        b = brute_betweenness(left)
        left = [e for e in left if b[e] < max(b.values())]
        part = {x: x for x in nodes}
        for _ in nodes:
            for u, v in left:
                part[u] = part[v] = min(part[u], part[v])
        q = sum(((u, v) in edges or (v, u) in edges) / (2 * m) - degree[u] * degree[v] / (4 * m * m) for u in nodes for v in nodes if part[u] == part[v])
        if q > best_q + 1e-9:
            best, best_q = part, q
    return best, best_q


def test_graph_against_brute_force(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(20)} | {(20, 21), (21, 22)})
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    want = brute_betweenness(edges)
    for limit in (1000, 1):  # sent adjacency, frontier joins
        got = {(r.u, r.v): r.betweenness for r in G.edge_betweenness(df, local_edges=limit).collect()}
        assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 2e-5 for e in want)
    comp = {r.id: r.component for r in G.connected_components(df).collect()}
    assert comp[22] == 20 and all(comp[u] == comp[v] for u, v in edges)
    want_part, want_q = brute_split(edges)
    for limit in (1000, 0):  # in one task, by a job a round
        lab = G.girvan_newman(df, local_edges=limit).collect()
        assert {r.id: r.label for r in lab} == want_part and all(r.modularity == pytest.approx(want_q, abs=1e-6) for r in lab)
    empty = df.where("false")
    assert G.edge_betweenness(empty).count() == 0 and G.connected_components(empty).count() == 0 and G.girvan_newman(empty).count() == 0 and G.label_propagation(empty).count() == 0


def test_long_chain_is_one_component(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)], "u bigint, v bigint")
    assert G.connected_components(df).select("component").distinct().count() == 1


def test_cooccurrence_both_plans(spark, monkeypatch):
    rng = random.Random(9)
    has = {n: {rng.randint(0, 12) for _ in range(8)} for n in range(25)}
    df = spark.createDataFrame([(n, i) for n, s in has.items() for i in s] + [(None, 1), (1, None)], "n bigint, i bigint")
    want = {(a, b, len(has[a] & has[b])) for a, b in itertools.combinations(range(25), 2) if len(has[a] & has[b]) >= 4}
    for cheap in (1e9, 0):
        monkeypatch.setattr(G, "CHEAP", cheap)
        assert {tuple(r) for r in G.cooccurrence_edges(df, "n", "i", 4).collect()} == want


def test_bfr_keeps_every_point_once(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 30, (4, 5))
    pts = [(int(k), [float(x) for x in centres[k % 4] + rng.normal(0, 1, 5)]) for k in range(400)] + [(1000 + k, [float(x) for x in rng.normal(0, 200, 5)]) for k in range(5)]
    df = spark.createDataFrame(pts, "i bigint, f array<double>")
    b = C.bfr(df, "i", "f", 4)
    labels = {r["index"]: r["label"] for r in b.labels().collect()}
    assert len(labels) == 405 and b.labels().count() == 405
    number, ds, cs, csp, rs = b.rounds[-1]
    assert number == 5 and ds + csp + rs == 405 and ds >= 0.95 * 400
    for k in range(4):
        own = [labels[i] for i in range(k, 400, 4) if labels[i] >= 0]
        assert len(set(own)) == 1


def test_mahalanobis_without_variance():
    d = C.mahalanobis(np.array([[1.0, 2.0], [1.0, 3.0]]), np.array([[1.0, 2.0]]), np.array([[0.0, 0.0]]))
    assert d[0, 0] == 0 and np.isinf(d[1, 0])


def test_boosted_trees_learn_and_spread(spark):
    import numpy as np

    from minegrid.operators import boosting as B

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = 2 * (x[:, 0] > 0.3) + x[:, 1] + 0.05 * rng.normal(size=3000)
    m = B.fit_matrix(x, y, rounds=60, depth=4, step=0.2, columns=0.6)
    held = rng.normal(size=(1000, 4))
    truth = 2 * (held[:, 0] > 0.3) + held[:, 1]
    assert np.sqrt(np.mean((m.predict(held) - truth) ** 2)) < 0.25 * truth.std()
    df = spark.createDataFrame([(f"u{k}", f"i{k}", float(y[k]), *map(float, x[k])) for k in range(400)] + [("n", None, None, None, 0.0, 0.0, 0.0)], "user string, item string, stars double, a double, b double, c double, prediction double")
    model = B.fit(df, ["a", "b", "c"], rounds=5, depth=3)
    got = {r.user: r.prediction for r in B.predict(model, df, ["a", "b", "c"]).collect()}
    direct = model.predict(np.nan_to_num(np.array([[*map(float, x[7, :3])]])))[0]
    assert len(got) == 401 and got["u7"] == pytest.approx(direct) and got["n"] is not None
    empty = B.fit(df.where("false"), ["a"], rounds=2, depth=2)
    assert [r.prediction for r in B.predict(empty, df.limit(1), ["a"]).collect()] == [0.0]


def test_exact_similar_equals_brute_force(spark):
    rng = random.Random(9)
    sets = {f"r{k}": {rng.randint(0, 12) for _ in range(rng.randint(1, 6))} for k in range(40)}
    rows = spark.createDataFrame([(r, f"m{m}") for r, s in sets.items() for m in s], "record string, member string")
    sizes = rows.groupBy("record").agg(F.count("*").alias("size"))
    got = {(r.a, r.b) for r in S.exact_similar(rows, sizes).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_what_a_scope_wrote_is_removed(spark, tmp_path):
    import os

    from minegrid import util

    keep = util.written(spark.range(3), "kept")
    with util.scope():
        inner = util.written(spark.range(5), "inner")
        assert inner.count() == 5
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and keep.count() == 3


def test_points_assigned_in_order_equal_a_plain_loop(spark):
    import numpy as np

    from minegrid.operators import clustering as C

    rng = np.random.default_rng(5)
    start = {k: rng.normal(5.0 * k, 1.0, size=(30, 2)) for k in range(2)}
    pts = np.concatenate([rng.normal(0, 1, size=(20, 2)), rng.normal(5, 1, size=(20, 2)), [[40.0, 40.0]]])
    own = {k: [x.copy() for x in v] for k, v in start.items()}
    want = []
    for p in pts:
        d = {k: np.sqrt((((p - np.mean(v, 0)) ** 2) / np.var(v, 0)).sum()) for k, v in own.items()}
        k = min(d, key=d.get)
        want.append(k if d[k] <= 2 * np.sqrt(2) else -1)
        if want[-1] >= 0:
            own[k].append(p)
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pts)], "index bigint, features array<double>")
    ds = {k: C.Summary(len(v), v.sum(0), (v**2).sum(0)) for k, v in start.items()}
    got = {r["index"]: r.d for r in C.assigned_in_order(df, ds, {}).collect()}
    assert [got[k] for k in range(len(pts))] == want
    with pytest.raises(ValueError):
        C.assigned_in_order(df, ds, {}, limit=3)
    e = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(np.concatenate(list(start.values()) * 3))], "vec_id bigint, embedding array<double>")
    assert C.bfr(e, "vec_id", "embedding", 2, in_order=True).labels().count() == 180
