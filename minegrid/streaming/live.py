"""The sketches on Structured Streaming: micro-batches of a file stream, state kept in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_family, linear_hash
from ..util import new_dir
from .sketches import BITS, PRIME, fm_estimates, number_of


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Feeds everything that is there now, micro-batch by micro-batch, to ``each``; a checkpoint makes it resume."""
    spark = stream.sparkSession
    w = stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", checkpoint or new_dir(spark, "stream"))
    w.start().awaitTermination()


class LiveBloom:
    """Bloom filter over a stream. Every micro-batch writes all bits set so far (at most ``bits`` rows) and its own new keys; writing it again is harmless."""

    def __init__(self, spark: SparkSession, key: str, hashes: int = 10, bits: int = BITS, seed: int = 1) -> None:
        self.spark, self.key, self.bits, self.family = spark, key, bits, hash_family(hashes, PRIME, seed)
        self.path = new_dir(spark, "bloom")
        self.done: set[int] = set()
        self.results: dict[int, tuple[int, int, float]] = {}

    def _past(self, name: str, schema: str, before: int) -> DataFrame:
        paths = [f"{self.path}/{name}/{b}" for b in sorted(self.done) if b < before]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def __call__(self, df: DataFrame, batch: int) -> None:
        x = number_of(F.col("key"))
        keys = df.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).cast("string").alias("key")).agg(F.count("*").alias("n"))
        keys = keys.withColumn("hs", F.array_distinct(F.array(*[linear_hash(x, a, b, PRIME, self.bits) for a, b in self.family])))
        before = [b for b in self.done if b < batch]
        known = self.spark.read.schema("bit bigint").parquet(f"{self.path}/bits/{max(before)}") if before else self.spark.createDataFrame([], "bit bigint")
        bits = known.withColumn("set", F.lit(True))
        # keys are kept only to tell false positives from true ones; a key is written by the first batch that has it
        seen = self._past("keys", "key string", batch).withColumn("seen", F.lit(True))
        asked = keys.select("key", "n", F.explode("hs").alias("bit")).join(bits, "bit", "left").groupBy("key", "n").agg(F.min(F.coalesce("set", F.lit(False))).alias("positive"))
        s = asked.join(seen, "key", "left").agg(
            F.coalesce(F.sum(F.when(F.col("positive") & F.col("seen").isNull(), F.col("n"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(~F.col("positive"), F.col("n"))), F.lit(0)).alias("negatives"),
        ).first()
        fpr = s["fp"] / (s["fp"] + s["negatives"]) if s["fp"] + s["negatives"] else 0.0
        self.results[batch] = (s["fp"], s["negatives"], fpr)
        keys.select(F.explode("hs").alias("bit")).union(known).distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bits/{batch}")
        keys.join(seen, "key", "left_anti").select("key").write.mode("overwrite").parquet(f"{self.path}/keys/{batch}")
        self.done.add(batch)


class LiveDistinct:
    """Distinct estimate of every micro-batch; no state across batches."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.results: dict[int, tuple[int, int]] = {}

    def __call__(self, df: DataFrame, batch: int) -> None:
        r = fm_estimates(df.withColumn("batch", F.lit(batch)), self.key).first()
        self.results[batch] = (r["truth"], r["estimate"]) if r else (0, 0)


class LiveSample:
    """Fixed-size uniform sample: the rows with the smallest digests so far (at most k rows are kept)."""

    def __init__(self, spark: SparkSession, identity: str, k: int = 100, tag: str = "b1") -> None:
        self.spark, self.identity, self.k, self.tag = spark, identity, k, tag
        self.path, self.at = new_dir(spark, "sample"), None

    def __call__(self, df: DataFrame, batch: int) -> None:
        d = F.md5(F.concat(F.lit(f"{self.tag}:"), F.col(self.identity).cast("string")))
        new = df.withColumn("_d", d)
        both = new if self.at is None else new.unionByName(self.spark.read.schema(new.schema).parquet(self.at))
        to = f"{self.path}/{batch}"
        both.dropDuplicates(["_d"]).orderBy("_d").limit(self.k).write.mode("overwrite").parquet(to)
        self.at = to

    def sample(self) -> DataFrame:
        return self.spark.read.parquet(self.at).drop("_d")


def windowed_counts(stream: DataFrame, at: str, key: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Event-time counts per window and key with a watermark for late rows (append mode)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
