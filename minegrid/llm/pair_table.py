"""Items that appear together: an incremental pair table with hash-bucketed persistent counts.

State below one path in the shared folder, in parquet and versioned per hash bucket: baskets (user, item), marginals
(item, n) and pairs (item_1 < item_2, m, n1, n2), where n1 and n2 are the marginals a pair's score is made of. A manifest
file names the live version of every bucket and the number of baskets; it is renamed into place last, so a batch
either counts whole or not at all, and opening the path again goes on from there.

A batch of signed records changes some baskets. Only pairs with a changed item of a changed basket emit deltas: +1 for
those that came to be, -1 for those that ceased; likewise marginals. Deltas are summed before they are merged into their
buckets, and only buckets they touch are written anew. In the same pass the scores that the batch affects (pairs that
changed or have an item whose marginal changed) get their new marginals; all others keep theirs. scores() reads the pair
table alone and applies the number of baskets N.

A large basket is cut in blocks of ``BLOCK`` items; every pair of blocks is a row keyed by both, which any task can
take, so no task holds a whole basket's pairs. Buckets are rebalanced by size when written, so a large one has several tasks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import clean_key, new_dir, written

BLOCK = 256
BUCKET_ROWS = 1 << 20  # rows a bucket should hold; the number of buckets is settled by the first batch
SCHEMAS = {"baskets": "user string, item string", "marginals": "item string, n bigint", "pairs": "item_1 string, item_2 string, m bigint, n1 bigint, n2 bigint"}
KEYS = {"baskets": ["user"], "marginals": ["item"], "pairs": ["item_1", "item_2"]}


class _Buckets:
    """A table in versioned hash buckets; ``at`` maps a bucket to its folder, relative to the root."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int | None, at: dict[int, str]) -> None:
        self.spark, self.root, self.name, self.buckets, self.at = spark, root, name, buckets, at

    def settle(self, rows: int) -> None:
        self.buckets = self.buckets or max(4, min(4096, -(-rows // BUCKET_ROWS)))

    def of(self) -> Column:
        return F.pmod(F.xxhash64(*KEYS[self.name]), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        return [r[0] for r in df.select(self.of()).distinct().collect()]  # at most ``buckets`` numbers

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/{p}" for b, p in sorted(self.at.items()) if wanted is None or b in wanted]
        return self.spark.read.schema(SCHEMAS[self.name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[self.name])

    def write(self, rows: DataFrame, touched: list[int], version: str) -> None:
        """Replaces the touched buckets by ``rows``; emptied ones vanish."""
        to = f"{self.name}/{version}"
        rows.withColumn("_b", self.of()).hint("rebalance", "_b").write.mode("errorifexists").partitionBy("_b").parquet(f"{self.root}/{to}")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{to}")
        found = {s.getPath().getName() for s in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)}
        for b in touched:
            if f"_b={b}" in found:
                self.at[b] = f"{to}/_b={b}"
            else:
                self.at.pop(b, None)


class PairTable:
    """Pair counts over baskets, kept up to date batch by batch. A ``path`` that exists is opened as it was left."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None) -> None:
        self.spark = spark
        self.root = path or new_dir(spark, "pairs")
        state = self._load() or {"batch": 0, "n_baskets": 0, "tables": {}}
        self.batch, self._n = state["batch"], state["n_baskets"]
        tables = {n: state["tables"].get(n, {"buckets": buckets, "at": {}}) for n in SCHEMAS}
        self.baskets, self.marginals, self.pairs = (_Buckets(spark, self.root, n, t["buckets"], {int(b): p for b, p in t["at"].items()}) for n, t in tables.items())

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self) -> dict | None:
        p, fs = self._path("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []
        if not names:
            return None
        p, fs = self._path(f"manifests/{names[-1]}")
        stream = fs.open(p)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _commit(self) -> None:
        self.batch += 1
        state = {"batch": self.batch, "n_baskets": self._n, "tables": {t.name: {"buckets": t.buckets, "at": t.at} for t in (self.baskets, self.marginals, self.pairs)}}
        draft, fs = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"manifests/{self.batch:09d}.json")[0]):
            raise RuntimeError("another writer has committed this batch")

    def apply(self, records: DataFrame, user: str, item: str, sign: Column | None = None) -> None:
        """Adds (sign > 0, the default) or removes (sign < 0) items of baskets.

        Keys are trimmed; rows without either key are ignored. A basket is a set: adding what is there or removing
        what isn't changes nothing; repeated rows count once; added and removed in one batch counts as added.
        """
        version = f"v{self.batch + 1:06d}-{uuid.uuid4().hex[:8]}"  # never used before
        ch = records.select(clean_key(user).alias("user"), clean_key(item).alias("item"), F.signum((sign if sign is not None else F.lit(1)).cast("double")).alias("s")).where("user is not null and item is not null and s != 0")
        ch = ch.groupBy("user", "item").agg(F.max("s").alias("s"))
        now = F.when(F.col("s") > 0, True).when(F.col("s") < 0, False)
        if self.baskets.at:
            ch = written(ch, "batch")
            old = self.baskets.read(self.baskets.touched(ch.select("user"))).join(ch.select("user").distinct(), "user", "left_semi")
            both = ch.join(old.withColumn("was", F.lit(True)), ["user", "item"], "full").withColumn("was", F.coalesce("was", F.lit(False)))
            state = both.select("user", "item", "was", F.coalesce(now, "was").alias("now"))
        else:
            state = ch.select("user", "item", F.lit(False).alias("was"), now.alias("now"))
        state = written(state.where("was or now"), "changed")
        diff = state.where("was != now").select("user", "item", F.when(F.col("now"), 1).otherwise(-1).alias("d"))
        users = state.groupBy("user").agg(F.count("*").alias("k"), F.max("was").alias("was"), F.max("now").alias("now"))
        seen = users.agg(F.sum(F.col("now").cast("int") - F.col("was").cast("int")).alias("grown"), F.sum("k").alias("rows"), F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("pairs")).first()
        for t in (self.baskets, self.marginals):
            t.settle(seen["rows"] or 0)
        self.pairs.settle(seen["pairs"] or 0)  # at most so many

        item_delta = written(diff.groupBy("item").agg(F.sum("d").cast("bigint").alias("n")), "item-delta")  # sum 0: touched all the same
        pair_delta = self._pair_deltas(state).groupBy("item_1", "item_2").agg(F.sum("d").alias("m")).where("m != 0")

        t = self.baskets.touched(diff.select("user"))
        if t:
            kept = self.baskets.read(t)
            if self.baskets.at:
                kept = kept.join(diff.where("d < 0").select("user", "item"), ["user", "item"], "left_anti")
            self.baskets.write(kept.unionByName(diff.where("d > 0").select("user", "item")), t, version)
        t = self.marginals.touched(item_delta)
        if t:
            self.marginals.write(self.marginals.read(t).unionByName(item_delta).groupBy("item").agg(F.sum("n").alias("n")).where("n > 0"), t, version)
        self._merge_pairs(pair_delta, item_delta, version)
        self._n += int(seen["grown"] or 0)
        self._commit()

    def _pair_deltas(self, state: DataFrame) -> DataFrame:
        """Signed pairs of changed baskets: a pair is there if both items are. Only pairs with a changed item are made."""
        moved = F.col("was") != F.col("now")
        size = state.groupBy("user").agg(F.count("*").alias("size"), F.count(F.when(moved, 1)).alias("k")).where("k > 0")
        big = size.where(F.col("size") > BLOCK).select("user", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        alive = state.join(size.select("user"), "user", "left_semi") if self.baskets.at else state
        s = alive.join(big, "user", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
        x = F.struct("item", "was", "now", moved.alias("moved"))
        cut = written(s.groupBy("user", "blocks", "blk").agg(F.collect_list(x).alias("ys"), F.collect_list(F.when(moved, x)).alias("xs")), "blocks")
        one = cut.where("blocks = 1").select("xs", "ys")
        # every block of changed items meets every block of its basket in a row of its own
        left = cut.where("blocks > 1 and size(xs) > 0").select("user", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), "xs")
        many = left.join(cut.where("blocks > 1").select("user", "blk", "ys"), ["user", "blk"]).select("xs", "ys")
        each = one.unionByName(many).select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
        each = each.where(F.when(F.col("y.moved"), F.col("x.item") < F.col("y.item")).otherwise(F.col("x.item") != F.col("y.item")))  # two changed items meet twice
        d = (F.col("x.now") & F.col("y.now")).cast("int") - (F.col("x.was") & F.col("y.was")).cast("int")
        return each.select(F.least("x.item", "y.item").alias("item_1"), F.greatest("x.item", "y.item").alias("item_2"), d.cast("bigint").alias("d")).where("d != 0")

    def _merge_pairs(self, delta: DataFrame, item_delta: DataFrame, version: str) -> None:
        """Sums deltas into the pairs of their buckets and gives all affected pairs their new marginals."""
        marginals = self.marginals.read()
        sides = [marginals.select(F.col("item").alias(f"item_{k}"), F.col("n").alias(f"new{k}")) for k in (1, 2)]
        if not self.pairs.at:
            new = delta.where("m > 0").join(sides[0], "item_1").join(sides[1], "item_2")
            self.pairs.write(new.select("item_1", "item_2", "m", F.col("new1").alias("n1"), F.col("new2").alias("n2")), list(range(self.pairs.buckets)), version)
            return
        delta = written(delta, "pair-delta")
        moved = item_delta.where("n != 0").select("item")
        old = self.pairs.read()
        # buckets with a pair whose count or marginals change
        hit = old.join(moved.withColumnRenamed("item", "item_1"), "item_1", "left_semi").select("item_1", "item_2").union(old.join(moved.withColumnRenamed("item", "item_2"), "item_2", "left_semi").select("item_1", "item_2"))
        t = self.pairs.touched(delta.select("item_1", "item_2").union(hit))
        if not t:
            return
        none = F.lit(None).cast("bigint")
        merged = self.pairs.read(t).unionByName(delta.select("item_1", "item_2", "m", none.alias("n1"), none.alias("n2"))).groupBy("item_1", "item_2").agg(F.sum("m").alias("m"), F.max("n1").alias("n1"), F.max("n2").alias("n2")).where("m > 0")
        # items whose marginals anyone may need: those that moved and those of new pairs
        need = moved.union(delta.select("item_1")).union(delta.select("item_2")).distinct()
        sides = [x.join(need.withColumnRenamed("item", f"item_{k}"), f"item_{k}", "left_semi") for k, x in enumerate(sides, 1)]
        both = merged.join(sides[0], "item_1", "left").join(sides[1], "item_2", "left")
        self.pairs.write(both.select("item_1", "item_2", "m", F.coalesce("new1", "n1").alias("n1"), F.coalesce("new2", "n2").alias("n2")), t, version)

    def n_baskets(self) -> int:
        return self._n

    def scores(self, min_together: int = 1) -> DataFrame:
        """item_1, item_2, m, n1, n2, lift (= m N / (n1 n2): times more often than by chance) and pmi (log2 of it)."""
        lift = F.col("m") * F.lit(float(self._n)) / (F.col("n1").cast("double") * F.col("n2"))
        return self.pairs.read().where(F.col("m") >= min_together).withColumn("lift", lift).withColumn("pmi", F.log2("lift"))


def pair_table(df: DataFrame, user: str, item: str, buckets: int | None = None, path: str | None = None) -> PairTable:
    """A table fed with ``df`` in three batches, as a stream of changes would come.

    By hash of the record: the first 30 of 32 parts are added, then one of them is taken back (signed -1) while the 31st
    comes, and at last what was taken back comes again with the 32nd.
    """
    t = PairTable(df.sparkSession, buckets, path)
    part = F.pmod(F.xxhash64(clean_key(user), clean_key(item)), F.lit(32))
    t.apply(df.where(part < 30), user, item)
    t.apply(df.where(part.isin(29, 30)), user, item, F.when(part == 29, -1).otherwise(1))
    t.apply(df.where(part.isin(29, 31)), user, item)
    return t
