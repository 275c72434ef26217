"""Distinct counts from delta-coded sorted runs of 64-bit hashes; parts merge by k-way union.

A run is the sorted set of the hashes of one cell (day and group) within one slice of the hash range, stored as
variable-length differences. A cell has as many slices as its own size asks for, so every run is bounded and small cells
stay whole; runs that are merged are first cut to the slices of what they merge to. Counts of slices
add up, because slices are disjoint. Two identifiers share a hash with probability 2^-64, so with n distinct
identifiers the count is short by at most one with probability under n(n-1)/2^65 (birthday bound); the same number
bounds the expected shortfall.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import clean_key

SLICE_TARGET = 50_000  # hashes a run should hold at most, on average
ALL = "\x01all"  # marks "all values" of a rolled-up group column, null ones included


def encode(hashes: np.ndarray) -> bytes:
    """Sorted unique unsigned 64-bit numbers to LEB128 differences (8-byte first value)."""
    h = np.asarray(hashes, dtype=np.uint64)
    if not len(h):
        return b""
    d = np.diff(h)
    size = np.ones(len(d), dtype=np.int64)
    for k in range(1, 10):
        size += d >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(d) else 0, dtype=np.uint8)
    start = ends - size
    for k in range(10):
        live = size > k
        if not live.any():
            break
        byte = (d[live] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[live] + k] = byte.astype(np.uint8) | np.where(size[live] > k + 1, 128, 0).astype(np.uint8)
    return h[:1].tobytes() + out.tobytes()


def decode(run: bytes) -> np.ndarray:
    if not run:
        return np.empty(0, np.uint64)
    first = np.frombuffer(run[:8], np.uint64)
    raw = np.frombuffer(run[8:], np.uint8)
    if not len(raw):
        return first.copy()
    last = np.flatnonzero(raw < 128)
    start = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    part = (raw & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    d = np.add.reduceat(part, start)
    return np.concatenate((first, first + np.cumsum(d, dtype=np.uint64)))


def union(runs: Sequence[bytes]) -> np.ndarray:
    """k-way union: pairs of runs are merged level by level, so every hash moves log2(k) times."""
    parts = [decode(r) for r in runs]
    while len(parts) > 1:
        parts = [np.union1d(a, b) if len(b) else a for a, b in zip(parts[::2], [*parts[1::2], *[np.empty(0, np.uint64)] * (len(parts) % 2)])]
    return np.unique(parts[0]) if parts else np.empty(0, np.uint64)


def _bits(n: Column) -> Column:
    """Slices of a cell of n hashes: 2 to this many, so that one holds about ``SLICE_TARGET`` at most."""
    return F.when(n > SLICE_TARGET, F.least(F.lit(40), F.ceil(F.log2(n / SLICE_TARGET)))).otherwise(0).cast("int")


def _slice(h: Column, bits: Column) -> Column:
    return F.when(bits > 0, F.call_function("shiftrightunsigned", h, F.lit(64) - bits)).otherwise(F.lit(0).cast("bigint"))


def build_runs(df: DataFrame, key: str, at: str, dims: Sequence[str]) -> DataFrame:
    """Runs per day and every roll-up of ``dims``: day, dims (ALL where rolled up), bits, slice, run, n.

    A cell has 2^bits slices of the hash range, by its own size. Rows without a key or a day are left out; a row whose
    dimension is null counts only where that dimension is rolled up. Repeated rows count once. An empty table gives no runs.
    """
    cells = [f"g{i}" for i in range(len(dims))]

    def rolled(d: DataFrame) -> DataFrame:
        for g in cells:
            d = d.withColumn(g, F.explode(F.array_compact(F.array(F.lit(ALL), F.col(g)))))
        return d

    base = df.select(F.xxhash64(clean_key(key)).alias("h"), clean_key(key).isNotNull().alias("ok"), F.to_date(at).alias("day"), *[F.col(c).cast("string").alias(g) for c, g in zip(dims, cells)]).where("ok and day is not null").drop("ok")
    # rows bound the distinct hashes of a cell; only cells of more than SLICE_TARGET rows are named
    big = rolled(base.groupBy("day", *cells).agg(F.count("*").alias("k"))).groupBy("day", *cells).agg(F.sum("k").alias("k")).where(F.col("k") > SLICE_TARGET).select("day", *cells, _bits(F.col("k")).alias("bits"))
    sliced = rolled(base.distinct()).join(big, ["day", *cells], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    sets = sliced.withColumn("slice", _slice(F.col("h"), F.col("bits"))).groupBy("day", *cells, "bits", "slice").agg(F.collect_set("h").alias("hs"))

    @F.pandas_udf("binary")
    def pack(hs: pd.Series) -> pd.Series:
        return hs.map(lambda a: encode(np.sort(np.asarray(a, dtype=np.int64).view(np.uint64))))

    named = [F.col(c).alias(d) for c, d in zip(cells, dims)]
    return sets.select("day", *named, "bits", "slice", pack("hs").alias("run"), F.size("hs").cast("bigint").alias("n"))


def respliced(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The runs cut or relabelled so that all of one ``by`` have the slices its total size asks for: adds nothing, changes bits, slice, run, n."""
    total = runs.groupBy(*by).agg(F.sum("n").alias("k"), F.max("bits").alias("b")).where((F.col("k") > SLICE_TARGET) | (F.col("b") > 0)).select(*by, _bits(F.col("k")).alias("want"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    cond = on[0] if on else F.lit(True)
    for o in on[1:]:
        cond = cond & o
    r = runs.alias("r").join(total.alias("t"), cond, "left").select("r.*", F.coalesce("t.want", "r.bits").alias("want"))
    coarse = r.where("want <= bits").withColumn("slice", F.expr("shiftright(slice, bits - want)")).withColumn("bits", F.col("want")).drop("want")
    schema = r.schema

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, slices, parts, ns = [], [], [], []
            for k, (run, want) in enumerate(zip(b["run"], b["want"])):
                h = decode(run)
                s = (h >> np.uint64(64 - want)).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                for i, j in zip(first, [*first[1:], len(h)]):
                    at.append(k)
                    slices.append(int(s[i]))
                    parts.append(encode(h[i:j]))
                    ns.append(int(j - i))
            out = b.iloc[at].reset_index(drop=True)
            yield out.assign(slice=pd.Series(slices, dtype="int64"), run=pd.Series(parts, dtype=object), n=pd.Series(ns, dtype="int64"))

    fine = r.where("want > bits").mapInPandas(cut, schema).withColumn("bits", F.col("want")).drop("want")
    return coarse.unionByName(fine)


def merge_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unites runs (of parts, days or groups) per ``by`` and slice into runs: by, bits, slice, run, n."""

    @F.pandas_udf("struct<run: binary, n: bigint>")
    def merge(lists: pd.Series) -> pd.DataFrame:
        sets = [union(list(r)) for r in lists]
        return pd.DataFrame({"run": [encode(u) for u in sets], "n": [len(u) for u in sets]})

    key = [*by, "bits", "slice"]
    lists = respliced(runs, by).groupBy(*key).agg(F.collect_list("run").alias("runs"))  # at most one run per part, day and group
    return lists.select(*key, merge("runs").alias("r")).select(*key, "r.run", "r.n")


def with_bound(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds ``max_error``: the birthday bound n(n-1)/2^65 on the expected shortfall of the count."""
    x = F.col(n).cast("double")
    return counts.withColumn("max_error", x * (x - 1) / F.lit(2.0**65))


def counts_by(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct identifiers per ``by`` (columns of the runs), with the error bound."""
    return with_bound(merge_runs(runs, by).groupBy(*by).agg(F.sum("n").alias("n")))


def recurrences(runs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """How many hashes of a group come on ``day`` and came last on ``before`` (null: never): dims, before, day, c.

    Per group and slice the runs of all days go through one k-way union that keeps, for every hash, its days. Counts of slices add
    up, so a group has at most one row per pair of days, however many hashes or slices it has.
    """
    schema = ", ".join(f"{d} string" for d in dims) + ", before date, day date, c bigint"

    def pairs(keys: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        per_day = cells.groupby("day")["run"].agg(lambda r: union(list(r)))
        days = sorted(per_day.index)
        h = np.concatenate([per_day[d] for d in days])
        at = np.repeat(np.arange(len(days)), [len(per_day[d]) for d in days])
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        before = np.full(len(h), -1)
        same = h[1:] == h[:-1]
        before[1:][same] = at[:-1][same]
        code, c = np.unique((before + 1) * len(days) + at, return_counts=True)
        known = [None, *days]
        out = pd.DataFrame({"before": [known[k] for k in code // len(days)], "day": [days[k] for k in code % len(days)], "c": c})
        for d, k in zip(dims, keys):
            out[d] = k
        return out[[*dims, "before", "day", "c"]]

    part = respliced(runs, dims).groupBy(*dims, "slice").applyInPandas(pairs, schema)
    return part.groupBy(*dims, "before", "day").agg(F.sum("c").alias("c"))


def count_ranges(runs: DataFrame, ranges: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct identifiers of each distinct range row (day_from, day_to, dims; ALL allowed): adds n.

    A hash counts for a range at its first day within it, i.e. where the day it came before lies before the range; so the
    table of recurrences answers every range of a group, and ranges never meet slices. Ranges that meet no
    run get 0, as do ranges that end before they begin. Ranges with a null day get null.
    """
    asked = ranges.select("day_from", "day_to", *dims).distinct()  # at most one per pair of days and group
    whole = asked.where("day_from is not null and day_to is not null")
    wanted = runs.join(whole.select(*dims).distinct(), list(dims), "left_semi") if dims else runs
    schema = "day_from date, day_to date, " + ", ".join(f"{d} string" for d in dims) + ", m bigint"

    def answer(keys: tuple, cells: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = lines[["day_from", "day_to", *dims]].copy()
        out["m"] = 0
        if len(cells) and len(lines):
            days = sorted(set(cells["day"]))
            place = {d: k for k, d in enumerate(days)}
            seen = np.zeros((len(days) + 1, len(days) + 1), dtype=np.int64)  # [day before + 1, day + 1]
            rows = [0 if b is None or b is pd.NaT else place[b] + 1 for b in cells["before"]]
            seen[rows, [place[d] + 1 for d in cells["day"]]] = cells["c"]
            total = seen.cumsum(0).cumsum(1)
            lo = np.searchsorted(days, list(lines["day_from"]), "left")
            hi = np.searchsorted(days, list(lines["day_to"]), "right")
            out["m"] = np.where(hi > lo, total[lo, hi] - total[lo, lo], 0)
        return out[["day_from", "day_to", *dims, "m"]]

    part = recurrences(wanted, dims).groupBy(*dims).cogroup(whole.groupBy(*dims)).applyInPandas(answer, schema)
    on = F.lit(True)
    a, s = asked.alias("a"), part.alias("s")
    for c in ("day_from", "day_to", *dims):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}"))
    n = F.when(F.col("a.day_from").isNotNull() & F.col("a.day_to").isNotNull(), F.coalesce("s.m", F.lit(0)))
    return a.join(s, on, "left").select("a.*", n.alias("n"))
