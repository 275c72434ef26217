"""Boosted regression trees on histograms: fitted on all rows by tasks side by side, applied to all rows in parallel.

Every task of one barrier stage holds its share of the rows, as binned columns of one byte each, and the tasks add up their
histograms level by level; only these and the exact quantiles pass between them. Residuals are summed in fixed point (steps
of 2^-24), so sums are exact and the model doesn't depend on how rows are dealt out. The rows of all tasks must fit their
memory together, at about 8 bytes a value while they are binned and 1 afterwards.
"""

from __future__ import annotations

import pickle
import secrets
import socket
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_TASK = 50_000  # at least so many before another task is worth its messages
BLOCK = 1 << 16  # rows worked on at once
STEPS = 2.0**24  # of fixed point
BINS = 64
WAIT = 900  # seconds for another task's histograms


@dataclass
class Trees:
    """Full binary trees by levels: split feature (-1: none, all go left), bin border and leaf values, above a constant."""

    edges: list[np.ndarray]
    feature: np.ndarray
    border: np.ndarray
    leaf: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows, out = np.arange(len(b)), np.full(len(b), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.border, self.leaf):
            node = np.zeros(len(b), np.int64)
            for level in range(depth):
                at = node + (1 << level) - 1
                node = 2 * node + ((b[rows, f[at]] > t[at]) & (f[at] >= 0))
            out += leaf[node]
        return out


def _alone(x: np.ndarray) -> np.ndarray:
    return x


def _smallest(x: np.ndarray, ranks: np.ndarray, total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The values of these ranks (0: the least) among the numbers of all tasks; every round divides the range left by 16."""
    bits = (np.sort(x) + 0.0).view(np.int64)
    keys = np.sort(np.where(bits < 0, ~bits.view(np.uint64), bits.view(np.uint64) | np.uint64(1 << 63)))  # ordered as the numbers are
    lo, hi = np.zeros(len(ranks), np.uint64), np.full(len(ranks), np.iinfo(np.uint64).max)
    while (lo < hi).any():
        step = (hi - lo) // np.uint64(16) + np.uint64(1)
        probes = lo[:, None] + np.minimum(step[:, None] * np.arange(16, dtype=np.uint64), (hi - lo)[:, None])
        enough = total(np.searchsorted(keys, probes, "right").astype(np.int64)) > ranks[:, None]
        first, at = enough.argmax(1), np.arange(len(ranks))
        found = enough.any(1)
        lo = np.where(found, np.where(first > 0, probes[at, np.maximum(first, 1) - 1] + np.uint64(1), lo), np.minimum(probes[:, -1], hi - np.uint64(1)) + np.uint64(1))
        hi = np.where(found, probes[at, first], hi)
    return np.where(lo >> np.uint64(63) > 0, lo & np.uint64((1 << 63) - 1), ~lo).view(np.float64)


def _edges(x: np.ndarray, n: int, total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Borders of the bins: the distinct ones of ``BINS`` - 1 exact quantiles over the ``n`` numbers of all tasks."""
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    if total is _alone:
        return np.unique(np.quantile(x, at))
    at = at * (n - 1)
    ranks, share = np.floor(at).astype(np.int64), at - np.floor(at)
    v = _smallest(x, np.concatenate([ranks, np.minimum(ranks + 1, n - 1)]), total)
    low, high = v[: len(at)], v[len(at) :]
    return np.unique(np.where(low == high, low, low + (high - low) * share))


def fit_columns(column: Callable[[int], np.ndarray], m: int, y: np.ndarray, total: Callable[[np.ndarray], np.ndarray] = _alone, rounds: int = 200, depth: int = 7, step: float = 0.05, columns: float = 0.4, least: int = 20, ridge: float = 1.0, seed: int = 0) -> Trees:
    """Least-squares boosting; every tree draws its share of ``columns``, every leaf holds at least ``least`` rows. Nulls must be filled.

    ``column`` gives this task's numbers of a feature, ``total`` adds up an array over all tasks. After the first level only the
    smaller child of a split is counted, the other is what remains of the parent.
    """
    rng = np.random.default_rng(seed)
    n, sum_y = (int(z) for z in total(np.array([len(y), np.rint(y * STEPS).sum()], np.float64)))
    edges = [_edges(column(k), n, total) if n else np.empty(0) for k in range(m)]
    model = Trees(edges, np.full((rounds, (1 << depth) - 1), -1, np.int64), np.zeros((rounds, (1 << depth) - 1), np.int64), np.zeros((rounds, 1 << depth)), sum_y / STEPS / n if n else 0.0)
    if not n or not m:
        return model
    cols = np.stack([np.searchsorted(edges[k], column(k), "left").astype(np.uint8) for k in range(m)])
    blocks = [np.ascontiguousarray(cols[:, at : at + BLOCK]) for at in range(0, len(y), BLOCK)]
    del cols
    rest = [y[at : at + BLOCK] - model.base for at in range(0, len(y), BLOCK)]
    places = np.arange(BLOCK)
    for r in range(rounds):
        drawn = rng.choice(m, max(1, round(columns * m)), replace=False)
        fixed, nodes = [np.rint(x * STEPS) for x in rest], [np.zeros(len(x), np.int64) for x in rest]
        small = pick = at = None
        for level in range(depth + 1):
            size, k = 1 << level, max(1, 1 << level >> 1)
            cells = k * BINS
            count, sums = np.zeros((len(drawn), cells), np.int64), np.zeros((len(drawn), cells))
            leaf_count, leaf_sums = np.zeros(size, np.int64), np.zeros(size)
            for i, (b, w) in enumerate(zip(blocks, fixed)):
                node, length = nodes[i], len(w)
                if level:
                    node = nodes[i] = 2 * node + (b.ravel().take(pick.take(node) * length + places[:length]) > at.take(node))
                if level == depth:
                    leaf_count += np.bincount(node, minlength=size)
                    leaf_sums += np.bincount(node, w, size)
                    continue
                rows = None
                if level:
                    up = node >> 1
                    rows = np.flatnonzero((node & 1) == small.take(up))
                    slot, w = up.take(rows) * BINS, w.take(rows)
                else:
                    slot = node
                for j, f in enumerate(drawn):
                    key = slot + (b[f] if rows is None else b[f].take(rows))
                    count[j] += np.bincount(key, minlength=cells)
                    sums[j] += np.bincount(key, w, cells)
            if level == depth:
                got = total(np.concatenate([leaf_count, leaf_sums]))
                model.leaf[r] = step * got[size:] / STEPS / (got[:size] + ridge)
                break
            got = total(np.stack([count, sums])).reshape(2, len(drawn), k, BINS)
            if level:
                both = np.empty((2, len(drawn), k, 2, BINS))
                each = np.arange(k)
                both[:, :, each, small], both[:, :, each, 1 - small] = got, whole - got
                got = both.reshape(2, len(drawn), size, BINS)
            whole = got
            c, s = whole[0].cumsum(-1), whole[1].cumsum(-1) / STEPS
            call, sall = c[..., -1:], s[..., -1:]
            g = s**2 / (c + ridge) + (sall - s) ** 2 / (call - c + ridge) - sall**2 / (call + ridge)
            g[(c < least) | (call - c < least)] = 0.0
            g = g.transpose(1, 0, 2).reshape(size, -1)
            best, which = g.argmax(1), np.arange(size)
            splits = g[which, best] > 1e-9
            pick, border = np.where(splits, drawn[best // BINS], 0), np.where(splits, best % BINS, 0)
            lefts = c[best // BINS, which, border]
            small = np.where(splits, (2 * lefts > call[0, :, 0]).astype(np.int64), 1)
            at = np.where(splits, border, 255)  # nothing lies beyond it: all go left
            model.feature[r, size - 1 : 2 * size - 1], model.border[r, size - 1 : 2 * size - 1] = np.where(splits, pick, -1), border
        rest = [x - model.leaf[r].take(node) for x, node in zip(rest, nodes)]
    return model


def fit_matrix(x: np.ndarray, y: np.ndarray, **params) -> Trees:
    """The same of rows in memory."""
    return fit_columns(lambda k: x[:, k], x.shape[1], y, **params)


def _received(peer: socket.socket, n: int) -> bytearray:
    got = bytearray(n)
    view, at = memoryview(got), 0
    while at < n:
        k = peer.recv_into(view[at:])
        if not k:
            raise ConnectionError("a task of the fit is gone")
        at += k
    return got


def _linked(context) -> Callable[[np.ndarray], np.ndarray]:
    """Adds up arrays over the tasks of a barrier stage: the first task gets and returns them over sockets.

    Spark's own ``allGather`` takes a second each time, so it passes only the port and a secret. If a task is lost, the others fail with
    it and Spark runs the stage again.
    """
    rank, tasks = context.partitionId(), context.getTaskInfos()
    server, secret = (socket.create_server(("", 0)), secrets.token_hex(16)) if rank == 0 else (None, "")
    port, secret = context.allGather(f"{server.getsockname()[1]} {secret}" if server else "")[0].split()
    peers: dict[int, socket.socket] = {}
    if server:
        server.settimeout(WAIT)
        while len(peers) < len(tasks) - 1:
            peer, _ = server.accept()
            peer.settimeout(WAIT)
            hello = bytes(_received(peer, len(secret) + 8))
            if secrets.compare_digest(hello[:-8], secret.encode()):
                peers[int(hello[-8:])] = peer
            else:
                peer.close()
        server.close()
    else:
        peers[0] = socket.create_connection((tasks[0].address.rsplit(":", 1)[0], int(port)), WAIT)
        peers[0].sendall(secret.encode() + b"%8d" % rank)
    for peer in peers.values():
        peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def total(x: np.ndarray) -> np.ndarray:
        size = x.nbytes
        if server:
            out = x.copy()
            for k in sorted(peers):
                out += np.frombuffer(_received(peers[k], size), x.dtype).reshape(x.shape)
            for peer in peers.values():
                peer.sendall(out.tobytes())
            return out
        peers[0].sendall(x.tobytes())
        return np.frombuffer(_received(peers[0], size), x.dtype).reshape(x.shape)

    return total


def fit(train: DataFrame, features: Sequence[str], label: str = "stars", n: int | None = None, rows_a_task: int = ROWS_A_TASK, **params) -> Trees:
    """A model of ``label`` from all rows; rows without one are left out, null features count 0. The model alone comes to the driver.

    ``n``: about how many rows there are (counted if not given), for the number of tasks. They must run at the same time; with
    dynamic allocation, under which Spark has no such stages, one task holds all rows.
    """
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{k}") for k, c in enumerate(features)])
    sc, m = train.sparkSession.sparkContext, len(features)
    dynamic = sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
    tasks = 1 if dynamic else max(1, min(sc.defaultParallelism, -(-(rows.count() if n is None else n) // rows_a_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = _alone, True
        if tasks > 1:
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            total, first = _linked(context), context.partitionId() == 0
        parts = [[c.to_numpy() for c in b.columns] for b in batches]

        def column(k: int) -> np.ndarray:
            return np.concatenate([p[k] for p in parts]) if parts else np.empty(0)

        model = fit_columns(lambda k: column(k + 1), m, column(0), total, **params)
        if first:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]}, pa.schema([("model", pa.binary())]))

    dealt = rows.repartition(1) if tasks == 1 else rows.repartition(tasks, *rows.columns)
    got = dealt.mapInArrow(run, "model binary", barrier=tasks > 1).collect()
    return pickle.loads(bytes(got[0]["model"])) if got else fit_matrix(np.empty((0, m)), np.empty(0), **params)


def predict(model: Trees, pairs: DataFrame, features: Sequence[str], keep: Sequence[str] = ("user", "item")) -> DataFrame:
    """(keep…, prediction) of every row."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    src = pairs.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f{k}") for k, c in enumerate(features)])
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[[f"_f{k}" for k in range(len(features))]].to_numpy(float)
            yield b[list(keep)].assign(prediction=shared.value.predict(x))

    return src.mapInPandas(run, f"{kinds}, prediction double")
