"""Memory-bounded clustering with discard, compression and retained sets; the summaries are sums, never points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_hash
from ..util import written


def hash_split(df: DataFrame, index: str, parts: int = 5, a: int = 769, b: int = 421, p: int = 2023) -> DataFrame:
    """Adds ``bucket``: ((a i + b) mod p) mod parts."""
    return df.withColumn("bucket", linear_hash(F.col(index), a, b, p, parts).cast("int"))


def cluster_summaries(df: DataFrame, label: str, features: str, places: int = 4) -> DataFrame:
    """(label, dim, n, s, ss): count, sum and sum of squares per cluster and dimension."""
    x = df.select(F.col(label).alias("label"), F.posexplode(F.col(features)).alias("dim", "x"))
    x = x.withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label", "dim").agg(F.count("*").alias("n"), F.round(F.sum("x"), places).alias("s"), F.round(F.sum(F.col("x") * F.col("x")), places).alias("ss"))


@dataclass
class Summary:
    """N, SUM, SUMSQ of a cluster."""

    n: int
    s: np.ndarray
    ss: np.ndarray

    def plus(self, o: Summary) -> Summary:
        return Summary(self.n + o.n, self.s + o.s, self.ss + o.ss)


def _matrix(parts: list[Summary]) -> tuple[np.ndarray, np.ndarray]:
    c = np.stack([p.s / p.n for p in parts])
    var = np.stack([np.maximum(p.ss / p.n - (p.s / p.n) ** 2, 0.0) for p in parts])
    return c, var


def mahalanobis(points: np.ndarray, centre: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Distances points x clusters with diagonal variances; a dimension without variance counts 0 where equal, else puts the point out of reach."""
    out = np.empty((len(points), len(centre)))
    for k in range(len(centre)):
        d2 = (points - centre[k]) ** 2
        flat = var[k] < 1e-18
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(flat, np.where(d2 < 1e-18, 0.0, np.inf), d2 / np.where(flat, 1.0, var[k]))
        out[:, k] = np.sqrt(t.sum(1))
    return out


def nearest_cluster(df: DataFrame, index: str, features: str, clusters: list[tuple[int, Summary]], limit: float | None = None) -> DataFrame:
    """(index, cluster, distance): the nearest cluster by diagonal Mahalanobis distance, ties to the smallest id; -1 beyond ``limit`` (default 2 sqrt(d)).

    ``clusters`` is the bounded list of summaries, sent to every task; points stay where they are.
    """
    kind = df.schema[index].dataType.simpleString()
    ids = np.array([i for i, _ in clusters], np.int64)
    shared = df.sparkSession.sparkContext.broadcast(_matrix([s for _, s in clusters]) if clusters else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            if shared.value is None:
                yield pd.DataFrame({"index": b["index"], "cluster": -1, "distance": np.inf})
                continue
            d = mahalanobis(np.stack(b["features"].to_numpy()).astype(float), *shared.value)
            k = d.argmin(1)
            best = d[np.arange(len(d)), k]
            top = 2 * math.sqrt(len(b["features"].iloc[0])) if limit is None else limit
            yield pd.DataFrame({"index": b["index"], "cluster": np.where(best <= top, ids[k], -1), "distance": best})

    return df.select(F.col(index).alias("index"), F.col(features).alias("features")).mapInPandas(run, f"index {kind}, cluster bigint, distance double")


def summaries_of(df: DataFrame, label: str = "label", features: str = "features") -> dict[int, Summary]:
    """Summaries per label; one vector row per cluster reaches the driver, sums are made before the shuffle."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(features).cast("array<double>"))
    g = df.groupBy(label).agg(F.count("*").alias("n"), Summarizer.sum(v).alias("s"), Summarizer.normL2(v).alias("q")).collect()
    return {r[label]: Summary(r["n"], r["s"].toArray(), r["q"].toArray() ** 2) for r in g}


IN_ORDER = 200_000  # points a chunk may have where they are assigned one after the other


def assigned_in_order(points: DataFrame, ds: dict[int, Summary], cs: dict[int, Summary], limit: int = IN_ORDER) -> DataFrame:
    """(index, features, d, c) with summaries updated after every point, in the order of the index: the sequential form.

    Each point depends on those before it, so a chunk is one task's work and must not exceed ``limit`` points.
    """
    if points.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} points in a chunk; use smaller chunks or frozen summaries")
    kind = points.schema["index"].dataType.simpleString()
    start = [({i: (s.n, s.s, s.ss) for i, s in x.items()}) for x in (ds, cs)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index", kind="stable").reset_index(drop=True)
        sets = []
        for x in start:
            ids = sorted(x)
            sets.append((ids, np.array([x[i][0] for i in ids], float), np.array([x[i][1] for i in ids], float), np.array([x[i][2] for i in ids], float)))
        out = np.full((len(pdf), 2), -1, np.int64)
        for r, f in enumerate(pdf["features"]):
            p = np.asarray(f, float)
            for side, (ids, n, s, ss) in enumerate(sets):
                if not ids:
                    continue
                centre = s / n[:, None]
                d = mahalanobis(p[None, :], centre, np.maximum(ss / n[:, None] - centre**2, 0.0))[0]
                k = int(d.argmin())
                if d[k] <= 2 * math.sqrt(len(p)):
                    out[r, side] = ids[k]
                    n[k] += 1
                    s[k] += p
                    ss[k] += p * p
                    break
        return pdf.assign(d=out[:, 0], c=out[:, 1])[["index", "features", "d", "c"]]

    return points.groupBy().applyInPandas(run, f"index {kind}, features array<double>, d bigint, c bigint")


def _kmeans(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Adds ``label``; asks for no more clusters than there are points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.limit(k).count()
    if n <= 1:
        return df.withColumn("label", F.lit(0))
    m = KMeans(k=min(k, n), seed=seed, featuresCol="_v", predictionCol="label").fit(df.withColumn("_v", array_to_vector(F.col("features").cast("array<double>"))))
    return m.transform(df.withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))).drop("_v")


class BFR:
    """Chunk by chunk: the discard set (k summaries), compression sets (summaries) and retained points (a table).

    Summaries are frozen while a chunk is assigned and updated after it, so a chunk is assigned in parallel; an update
    after every single point is sequential and differs slightly (``in_order``, for chunks of bounded size). Merging adds summaries; points that leave the
    retained set move, and no point is ever counted twice.
    """

    def __init__(self, k: int, seed: int = 0, in_order: bool = False) -> None:
        self.k, self.seed, self.in_order = k, seed, in_order
        self.ds: dict[int, Summary] = {}
        self.cs: dict[int, Summary] = {}
        self.rs: DataFrame | None = None
        self.member: DataFrame | None = None  # (index, ds, cs)
        self.into: dict[int, int] = {}  # merged compression set -> where it went (compression sets negative: -cs-2)
        self.next_cs = 0
        self.rounds: list[tuple[int, int, int, int, int]] = []

    def _keep(self, rows: DataFrame, name: str) -> None:
        rows = written(rows, name)
        self.member = rows if self.member is None else self.member.unionByName(rows)

    def _compress(self) -> None:
        """Retained points to compression sets when there are more than 5k: groups of at least two points leave."""
        n = self.rs.count()
        if n <= 5 * self.k:
            return
        lab = written(_kmeans(self.rs, 5 * self.k, self.seed), "rs-labels")
        size = lab.groupBy("label").agg(F.count("*").alias("n"))
        lab = lab.join(size, "label")
        first = self.next_cs
        for label, s in summaries_of(lab.where("n > 1")).items():
            self.cs[first + label] = s
        self.next_cs = first + 5 * self.k
        self._keep(lab.where("n > 1").select("index", F.lit(None).cast("bigint").alias("ds"), (F.lit(first) + F.col("label")).cast("bigint").alias("cs")), "to-cs")
        self.rs = written(lab.where("n = 1").select("index", "features"), "rs")

    def _note(self, number: int) -> None:
        self.rounds.append((number, sum(s.n for s in self.ds.values()), len(self.cs), sum(s.n for s in self.cs.values()), self.rs.count()))

    def start(self, chunk: DataFrame) -> None:
        """The first chunk: singletons of a 5k-means are retained, a k-means of the rest makes the discard sets."""
        lab = written(_kmeans(chunk, 5 * self.k, self.seed), "seed-labels")
        lab = lab.join(lab.groupBy("label").agg(F.count("*").alias("n")), "label")
        rs = lab.where("n = 1").select("index", "features")
        rest = written(_kmeans(lab.where("n > 1").select("index", "features"), self.k, self.seed), "ds-labels")
        rest = rest.join(rest.groupBy("label").agg(F.count("*").alias("n")), "label")
        self.ds = dict(summaries_of(rest.where("n > 1")))
        self._keep(rest.where("n > 1").select("index", F.col("label").cast("bigint").alias("ds"), F.lit(None).cast("bigint").alias("cs")), "seed-members")
        self.rs = written(rs.unionByName(rest.where("n = 1").select("index", "features")), "rs")
        self._compress()
        self._note(1)

    def add(self, chunk: DataFrame, last: bool = False) -> None:
        pts = chunk.select("index", "features")
        if self.in_order:
            got = written(assigned_in_order(pts, self.ds, self.cs), "assigned")
        else:
            a = nearest_cluster(pts, "index", "features", sorted(self.ds.items())).select("index", F.col("cluster").alias("d"))
            c = nearest_cluster(pts, "index", "features", sorted(self.cs.items())).select("index", F.col("cluster").alias("c"))
            got = written(pts.join(a, "index").join(c, "index"), "assigned")
        for label, s in summaries_of(got.where("d >= 0").select(F.col("d").alias("label"), "features")).items():
            self.ds[label] = self.ds[label].plus(s)
        for label, s in summaries_of(got.where("d < 0 and c >= 0").select(F.col("c").alias("label"), "features")).items():
            self.cs[label] = self.cs[label].plus(s)
        none = F.lit(None).cast("bigint")
        self._keep(got.where("d >= 0 or c >= 0").select("index", F.when(F.col("d") >= 0, F.col("d")).otherwise(none).alias("ds"), F.when((F.col("d") < 0) & (F.col("c") >= 0), F.col("c")).otherwise(none).alias("cs")), "members")
        self.rs = written(self.rs.unionByName(got.where("d < 0 and c < 0").select("index", "features")), "rs")
        self._compress()
        self._merge_cs()
        if last:
            self._into_ds()
        self._note(len(self.rounds) + 1)

    def _merge_cs(self) -> None:
        """Merges compression sets whose centroids lie within 2 sqrt(d) of each other, nearest first, until none do."""
        while len(self.cs) > 1:
            ids = sorted(self.cs)
            c, var = _matrix([self.cs[i] for i in ids])
            d = mahalanobis(c, c, var)
            np.fill_diagonal(d, np.inf)
            d = np.minimum(d, d.T)
            i, j = np.unravel_index(d.argmin(), d.shape)
            if d[i, j] > 2 * math.sqrt(c.shape[1]):
                return
            x, y = ids[min(i, j)], ids[max(i, j)]
            self.cs[x] = self.cs[x].plus(self.cs.pop(y))
            self.into[y] = -x - 2

    def _into_ds(self) -> None:
        for i in sorted(self.cs):
            ids = sorted(self.ds)
            if not ids:
                return
            c, var = _matrix([self.ds[k] for k in ids])
            d = mahalanobis((self.cs[i].s / self.cs[i].n)[None, :], c, var)[0]
            k = int(d.argmin())
            if d[k] <= 2 * math.sqrt(c.shape[1]):
                self.ds[ids[k]] = self.ds[ids[k]].plus(self.cs.pop(i))
                self.into[i] = ids[k]

    def labels(self) -> DataFrame:
        """(index, label): the discard set's id; -1 for points of compression sets and retained points."""
        spark = self.rs.sparkSession
        where = {}
        for c in self.into:
            at = c
            while at in self.into and self.into[at] < 0:
                at = -self.into[at] - 2
            if at in self.into:
                where[c] = self.into[at]
        to = spark.createDataFrame([(int(c), int(d)) for c, d in where.items()] or [(-1, -1)], "cs bigint, to bigint")  # at most one row per compression set
        m = self.member.join(F.broadcast(to), "cs", "left").select("index", F.coalesce("ds", "to", F.lit(-1)).cast("bigint").alias("label"))
        return m.unionByName(self.rs.select("index", F.lit(-1).cast("bigint").alias("label")))

    def stats(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rounds, "round int, ds_points bigint, cs_clusters bigint, cs_points bigint, rs_points bigint")


def bfr(df: DataFrame, index: str, features: str, k: int, parts: int = 5, seed: int = 0, in_order: bool = False) -> BFR:
    """Runs all hash buckets of ``df`` through one BFR; rows with a null index or null features are left out."""
    pts = written(hash_split(df.where(F.col(index).isNotNull() & F.col(features).isNotNull()), index, parts).select(F.col(index).alias("index"), F.col(features).cast("array<double>").alias("features"), "bucket"), "points")
    b = BFR(k, seed, in_order)
    b.start(pts.where("bucket = 0").drop("bucket"))
    for n in range(1, parts):
        b.add(pts.where(F.col("bucket") == n).drop("bucket"), last=n == parts - 1)
    return b
