"""Orphan references: parent keys compressed to contiguous runs, references matched as-of to the run before them.

Keys become order-preserving integers. Integer keys are their own; text keys get their place among all distinct
keys of the column's parents and references, sorted. So parents that exist side by side form a run, and a gap between
two runs is where only orphans lie. Every run carries its first code, its last code and, by offset, the life spans of
its members. A reference takes the last run that starts at or before it; beyond the run's end it has no target.

Scale: only *distinct* referenced keys (with the least and greatest reference time, combined before the
shuffle) take part in the numbering and the as-of match, so a key that holds a third of all rows is one row there. Numbering
sorts distinct keys by ranges, one segment each; nothing is numbered in one task. Rows are touched again only to join
them with the keys that have at least one case, spread by a salt. A segment holds at most ``2**20`` codes (integer
keys) or a range partition's keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import clean_key, written

RUN_LEN = 64  # a run is also cut at multiples of this, so that what a window row carries stays small
SALTS = 16


@dataclass(frozen=True)
class Reference:
    """A referring column and its target: key column, first-seen and deleted-at columns (None: never)."""

    column: str
    parent: DataFrame
    parent_key: str
    arrived: str | None = None
    deleted: str | None = None


SEGMENT_BITS = 20


def coded(lives: DataFrame, keys: DataFrame, integers: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parents and references, both one row per (ref_column, key), with ``code`` and ``seg``.

    ``integers``: the code is the key itself, null where the key is no plain integer ("007" is none). Otherwise it is
    the key's place in the sorted order of all keys of both sides, counted within its segment.
    """
    if integers:
        n = F.col("key").try_cast("bigint")
        return tuple(x.withColumn("code", F.when(n.cast("string") == F.col("key"), n)).withColumn("seg", F.shiftright("code", SEGMENT_BITS)) for x in (lives, keys))
    both = lives.withColumn("is_ref", F.lit(0)).unionByName(keys.withColumn("is_ref", F.lit(1)), allowMissingColumns=True)
    ranged = both.repartitionByRange("ref_column", "key").withColumn("seg", F.spark_partition_id().cast("bigint"))
    w = Window.partitionBy("seg").orderBy("ref_column", "key")
    # written once: both sides must see the same segments
    numbered = written(ranged.withColumn("code", F.dense_rank().over(w).cast("bigint")), "numbered-keys")
    side = lambda k, df: numbered.where(F.col("is_ref") == k).select(*df.columns, "code", "seg")
    return side(0, lives), side(1, keys)


def parent_lives(refs: Sequence[Reference]) -> DataFrame:
    """One row per (ref_column, key) of all targets: earliest arrival and earliest deletion, nulls ignored."""
    parts = []
    for r in refs:
        none = F.lit(None).cast("timestamp")
        parts.append(
            r.parent.select(
                F.lit(r.column).alias("ref_column"), clean_key(r.parent_key).alias("key"),
                (F.col(r.arrived) if r.arrived else none).alias("a"), (F.col(r.deleted) if r.deleted else none).alias("d"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key is not null").groupBy("ref_column", "key").agg(F.min("a").alias("arrived"), F.min("d").alias("deleted"))


def key_runs(parents: DataFrame) -> DataFrame:
    """Runs of consecutive codes: ref_column, seg, code (= run start), run_end, members (arrived, deleted) by offset."""
    p = parents.where("code is not null")
    w = Window.partitionBy("ref_column", "seg").orderBy("code")
    before = F.lag("code").over(w)
    starts = F.when((F.col("code") == before + 1) & (F.pmod(F.col("code"), F.lit(RUN_LEN)) != 0), 0).otherwise(1)
    p = p.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.groupBy("ref_column", "seg", "run").agg(F.min("code").alias("code"), F.max("code").alias("run_end"), F.array_sort(F.collect_list(F.struct("code", "arrived", "deleted"))).alias("members"))
    return runs.select("ref_column", "seg", "code", "run_end", F.transform("members", lambda m: F.struct(m["arrived"].alias("arrived"), m["deleted"].alias("deleted"))).alias("members"))


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of match of coded references: adds ``hit`` (arrived, deleted of the target; null: beyond the run's end, or no code)."""
    kept = [c for c in keys.columns if c not in ("code", "seg")]
    lost = keys.where("code is null").select(*kept, F.lit(None).cast(runs.schema["members"].dataType.elementType).alias("hit"))
    side = runs.select("ref_column", "seg", "code", F.lit(0).alias("is_ref"), F.struct(F.col("code").alias("start"), F.col("run_end").alias("end"), "members").alias("run"))
    refs = keys.where("code is not null").withColumn("is_ref", F.lit(1))
    w = Window.partitionBy("ref_column", "seg").orderBy("code", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    both = side.unionByName(refs, allowMissingColumns=True).withColumn("r", F.last("run", ignorenulls=True).over(w)).where("is_ref = 1")
    inside = F.col("r").isNotNull() & (F.col("code") <= F.col("r.end"))
    hit = F.when(inside, F.try_element_at("r.members", (F.col("code") - F.col("r.start") + 1).cast("int")))
    return both.select(*kept, hit.alias("hit")).unionByName(lost)


def run_report(rows: DataFrame, refs: Sequence[Reference], integers: bool = False) -> DataFrame:
    """Per referring column: parents, runs they form, the longest run, and distinct references matched."""
    keys = referenced(rows, refs, F.lit(None).cast("timestamp"))
    parents, keys = coded(parent_lives(refs), keys.groupBy("ref_column", "key").agg(F.min("at").alias("first_at")), integers)
    runs = written(key_runs(parents), "runs")
    n = F.size("members").cast("bigint")
    shape = runs.groupBy("ref_column").agg(F.sum(n).alias("n_parents"), F.count("*").alias("n_runs"), F.max(n).alias("longest"))
    hits = match_runs(keys, runs).groupBy("ref_column").agg(F.count("*").alias("n_references"), F.count("hit").alias("n_matched"))
    return shape.join(hits, "ref_column", "full")


def referenced(rows: DataFrame, refs: Sequence[Reference], at: Column, row_id: Column | None = None) -> DataFrame:
    """One row (row_id, at, ref_column, key) per reference that has a key."""
    base = rows.select((row_id if row_id is not None else F.lit(None)).alias("row_id"), at.alias("at"), *[clean_key(r.column).alias(f"k{i}") for i, r in enumerate(refs)])
    long = base.select("row_id", "at", F.explode(F.array(*[F.struct(F.lit(r.column).alias("ref_column"), F.col(f"k{i}").alias("key")) for i, r in enumerate(refs)])).alias("x"))
    return long.select("row_id", "at", "x.ref_column", "x.key").where("key is not null")


def orphans(rows: DataFrame, row_id: str, at: Column, refs: Sequence[Reference], integers: bool = False) -> DataFrame:
    """One row (row_id, ref_column, kind, at) per reference whose target does not exist at its time.

    kind: 'missing' (no such parent key at all), 'late' (referred to before the parent's first arrival),
    'deleted' (at or after its first deletion). A reference that is both late and deleted gives both kinds.
    References whose key is null or blank are no cases; a null ``at`` can only be 'missing'. Repeated rows
    give one case each only if their row_id differs. ``integers`` declares keys to be integers; a text that
    is no plain integer is then missing. Empty tables give no rows (empty parent: every reference is missing).
    """
    long = referenced(rows, refs, at, F.col(row_id))
    keys = long.groupBy("ref_column", "key").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    parents, keys = coded(parent_lives(refs), keys, integers)
    seen = match_runs(keys, key_runs(parents))
    suspects = seen.where(F.col("hit").isNull() | (F.col("first_at") < F.col("hit.arrived")) | (F.col("last_at") >= F.col("hit.deleted"))).select(
        "ref_column", "key", F.col("hit").isNull().alias("missing"), F.col("hit.arrived").alias("arrived"), F.col("hit.deleted").alias("deleted")
    )
    suspects = suspects.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = long.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("missing"), F.lit("missing")),
            F.when(~F.col("missing") & (F.col("at") < F.col("arrived")), F.lit("late")),
            F.when(~F.col("missing") & (F.col("at") >= F.col("deleted")), F.lit("deleted")),
        )
    )
    return salted.join(suspects, ["ref_column", "key", "salt"]).select(F.col("row_id").alias(row_id), "ref_column", F.explode(kinds).alias("kind"), "at")


def orphan_report(cases: DataFrame) -> DataFrame:
    """Cases per referring column, kind and month of the reference (null month: no time)."""
    return cases.groupBy("ref_column", "kind", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
