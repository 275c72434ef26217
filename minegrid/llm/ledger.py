"""Has this key been seen before? An exact ledger of earlier keys, hash-partitioned and sorted on disk; its error is zero.

The ledger is a few runs: tables bucketed by the key's hash and sorted within buckets, one file a bucket. A batch's
keys (the first arrival of each, found by a minimum that combines before the shuffle, so a key that holds a third of the rows
stays one row) are shuffled once to the same buckets; each run is then sort-merge left-joined as it lies, without
moving or sorting the history. New keys become a run of their own; runs of like size are merged, bucket by bucket, so b
batches leave about log2(b) runs and a key is written log2(b) times. Rows are told apart by a join on (key, arrival): only
the first arrivals of new keys match, so no hot key gathers in one task.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import clean_key, new_dir, remove_dir, written

BUCKET_ROWS = 1 << 20  # keys a bucket should hold; a ledger that outgrows its buckets is written anew with four times as many

#: Settings under which a bucketed, sorted table is joined as it lies.
_AS_IT_LIES = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def settings(spark: SparkSession, **conf: str):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class KeyLedger:
    """Persistent set of the keys seen so far. ``path`` is reopened if it holds a ledger, else a new one is made."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 8) -> None:
        self.spark, self.path = spark, path or new_dir(spark, "ledger")
        self.tables: dict[str, str] = {}
        state = self._load() or {"version": 0, "buckets": buckets, "runs": []}
        self.version, self.buckets, self.runs = state["version"], state["buckets"], [tuple(r) for r in state["runs"]]

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self) -> dict | None:
        p, fs = self._file("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []
        if not names:
            return None
        p, fs = self._file(f"manifests/{names[-1]}")
        stream = fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _commit(self) -> None:
        self.version += 1
        draft, fs = self._file(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"version": self.version, "buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()
        if not fs.rename(draft, self._file(f"manifests/{self.version:09d}.json")[0]):
            raise RuntimeError("another writer has committed this batch")

    def _run(self, name: str) -> DataFrame:
        """A run as a table, known to the catalog as bucketed and sorted."""
        if name not in self.tables:
            at = f"minegrid_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {at} (key STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = at
        return self.spark.table(self.tables[name])

    def _write(self, keys: DataFrame) -> str:
        """Keys that lie in their buckets already, one task each, as a new run."""
        name = f"run-{uuid.uuid4().hex[:12]}"
        at = f"minegrid_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(at)
        self.tables[name] = at
        return name

    def history(self) -> DataFrame:
        """All keys."""
        out = self.spark.createDataFrame([], "key string")
        for name, _ in self.runs:
            out = out.unionByName(self._run(name))
        return out

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """The rows of ``firsts`` (distinct key, …) whose key is in no run; they lie in their buckets."""
        fresh = firsts.repartition(self.buckets, "key").sortWithinPartitions("key")
        for k, (name, _) in enumerate(self.runs):
            known = self._run(name).select(F.col("key").alias(f"k{k}")).hint("merge")
            fresh = fresh.join(known, F.col("key") == F.col(f"k{k}"), "left").where(F.col(f"k{k}").isNull()).drop(f"k{k}")
        return fresh

    def _append(self, keys: DataFrame, n: int) -> None:
        old = list(self.runs)
        total = n + sum(m for _, m in self.runs)
        if total > BUCKET_ROWS * self.buckets:
            everything = self.history().unionByName(keys)
            while total > BUCKET_ROWS * self.buckets:
                self.buckets *= 4
            self.runs = [(self._write(everything.repartition(self.buckets, "key")), total)]
        else:
            new, size = self._write(keys.repartition(self.buckets, "key")), n
            while self.runs and self.runs[-1][1] < 2 * size:  # sizes stay at least twofold apart
                last, m = self.runs.pop()
                both = self._run(last).withColumnRenamed("key", "a").hint("merge").join(self._run(new).withColumnRenamed("key", "b"), F.col("a") == F.col("b"), "full")
                old.append((new, size))
                new, size = self._write(both.select(F.coalesce("a", "b").alias("key"))), size + m
            self.runs.append((new, size))
        self._commit()
        for name in {r for r, _ in old} - {r for r, _ in self.runs}:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name, 'minegrid_none')}")
            remove_dir(self.spark, f"{self.path}/{name}")

    def judge(self, batch: DataFrame, key: str, order: str) -> DataFrame:
        """The batch with a column ``seen``; its new keys are appended.

        seen: the trimmed key occurs in an earlier batch or in a row of this one with a smaller ``order``. Rows tied
        at the first order are all unseen; a null order counts as after all others. Rows without a key (null or
        blank) get null. Repeated rows with a larger order are seen. An empty batch gives no rows and appends none.
        Other columns are carried along whatever their names; one called seen is replaced.
        """
        rows = batch.select(F.struct("*").alias("row"), clean_key(key).alias("k"), F.col(order).alias("o"))
        firsts = rows.where("k is not null").groupBy(F.col("k").alias("key")).agg(F.min("o").alias("first"))
        with settings(self.spark, **_AS_IT_LIES):
            fresh = written(self.unseen(firsts), "fresh")
            n = fresh.count()
            if n:
                self._append(fresh.select("key"), n)
        first = fresh.select("key", "first", F.lit(True).alias("new"))
        out = rows.join(first, (F.col("k") == F.col("key")) & F.col("o").eqNullSafe(F.col("first")), "left")
        kept = [F.col("row")[c].alias(c) for c in batch.columns if c != "seen"]
        return out.select(*kept, F.when(F.col("k").isNotNull(), F.col("new").isNull()).alias("seen"))


def judge_in_batches(df: DataFrame, key: str, order: str, batches: int = 4) -> DataFrame:
    """Feeds ``df`` to one ledger in ``batches`` consecutive ranges of a numeric ``order`` column; returns all rows with ``seen``."""
    spark = df.sparkSession
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    ledger = KeyLedger(spark)
    if lo is None:
        return ledger.judge(df, key, order)
    step = max(1, -(-(int(hi) - int(lo) + 1) // batches))
    out = None
    for n, start in enumerate(range(int(lo), int(hi) + 1, step)):
        part = (F.col(order) >= start) & (F.col(order) < start + step)
        if n == batches - 1 or start + step > hi:
            part = (F.col(order) >= start) | F.col(order).isNull()
        got = ledger.judge(df.where(part), key, order)
        out = got if out is None else out.unionByName(got)
    return out
