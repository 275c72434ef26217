"""Stream operators over numbered batches, in relational form; ``live.py`` feeds the same logic from Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bytes_mod, hash_family, linear_hash, trailing_zeros
from ..operators.relational import dense_index
from ..util import written

PRIME = 2147483647
BITS = 69997


def batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Adds ``seq`` (from 1) and ``batch`` (from 0): consecutive windows of ``size`` rows in the given order."""
    return dense_index(df, *order).withColumn("seq", F.col("idx") + 1).withColumn("batch", F.floor(F.col("idx") / size).cast("bigint")).drop("idx")


def number_of(key: Column) -> Column:
    """A key's UTF-8 bytes as a number modulo the prime."""
    return bytes_mod(key.cast("string"), PRIME)


def bloom_fpr(stream: DataFrame, key: str, hashes: int = 10, bits: int = BITS, seed: int = 1) -> DataFrame:
    """(batch, fp, negatives, fpr) of a Bloom filter that scores a batch before it takes it in.

    Only distinct keys are hashed: a bit is set from the first batch of any key that has it, so a key tests positive
    in batch t if the latest of its bits was set before t. A row is a false positive if it is positive and its
    key is new in its batch. fpr = fp / (fp + rows that test negative), 0 where there are none. Null keys are left out.
    """
    rows = stream.where(F.col(key).isNotNull()).groupBy("batch", F.col(key).alias("key")).agg(F.count("*").alias("n"))
    firsts = written(rows.groupBy("key").agg(F.min("batch").alias("first")), "firsts")
    x = number_of(F.col("key"))
    marks = firsts.select("key", "first", F.explode(F.array_distinct(F.array(*[linear_hash(x, a, b, PRIME, bits) for a, b in hash_family(hashes, PRIME, seed)]))).alias("bit"))
    marks = written(marks, "marks")
    at = marks.groupBy("bit").agg(F.min("first").alias("at"))
    ready = marks.join(at, "bit").groupBy("key").agg(F.max("at").alias("ready"), F.first("first").alias("first"))
    j = rows.join(ready, "key")
    fp = F.sum(F.when((F.col("first") == F.col("batch")) & (F.col("ready") < F.col("batch")), F.col("n")).otherwise(0))
    neg = F.sum(F.when(F.col("ready") >= F.col("batch"), F.col("n")).otherwise(0))
    s = j.groupBy("batch").agg(fp.alias("fp"), neg.alias("negatives"))
    return s.withColumn("fpr", F.round(F.when(F.col("fp") + F.col("negatives") > 0, F.col("fp") / (F.col("fp") + F.col("negatives"))).otherwise(0.0), 9))


def fm_estimates(stream: DataFrame, key: str, hashes: int = 10, modulus: int = BITS, seed: int = 1) -> DataFrame:
    """(batch, truth, estimate): per batch the rounded mean over hashes of 2^(most trailing zeros), and the real distinct count."""
    fam = hash_family(hashes, PRIME, seed)
    rows = stream.where(F.col(key).isNotNull()).select("batch", F.col(key).alias("key")).distinct().withColumn("x", number_of(F.col("key")))
    most = [F.max(trailing_zeros(linear_hash(F.col("x"), a, b, PRIME, modulus))).alias(f"r{k}") for k, (a, b) in enumerate(fam)]
    got = rows.groupBy("batch").agg(F.count("*").alias("truth"), *most)
    mean = sum((F.pow(F.lit(2.0), F.col(f"r{k}")) for k in range(hashes)), F.lit(0.0)) / hashes
    return got.select("batch", "truth", F.bround(mean, 0).cast("bigint").alias("estimate"))


def digest_number(tag: str, seq: Column) -> Column:
    """48 digest bits of a tagged sequence number, as a bigint."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:"), seq.cast("string"))), 1, 12), 16, 10).cast("bigint")


def reservoir_snapshots(stream: DataFrame, key: str, size: int = 100, shown: Sequence[int] = (0, 20, 40, 60, 80), tag: str = "r1") -> DataFrame:
    """(batch, seq, slot_…): the reservoir after every batch, at the shown slots.

    Rows 1 to ``size`` fill the slots in order; row n enters with probability size / n and overwrites a uniform slot.
    Both draws are digests of n, so a slot's content is its last accepted row: the accepted rows of a slot, few as they
    are, cut the batches into spans, in place of a sequential pass.
    """
    n = F.col("seq")
    takes = (n <= size) | (digest_number(f"{tag}a", n).cast("decimal(18,0)") * n.cast("decimal(19,0)") < F.lit(size << 48).cast("decimal(38,0)"))
    slot = F.when(n <= size, n - 1).otherwise(F.pmod(digest_number(f"{tag}b", n), F.lit(size)))
    s = stream.select("batch", "seq", F.col(key).alias("key")).withColumn("slot", F.when(takes, slot))
    # a slot's last row up to a batch: rows that overwrite it later are found by rank within the slot, and only the
    # accepted rows of shown slots (about size ln(n / size) / size each) take part
    taken = s.where(F.col("slot").isin(*shown))
    nth = Window.partitionBy("slot").orderBy("seq")
    spans = written(taken.select("slot", "key", "batch", F.lead("batch").over(nth).alias("until")), "slots")
    ends = s.groupBy("batch").agg(F.max("seq").alias("end"))
    out = ends
    for k in shown:
        own = F.broadcast(spans.where((F.col("slot") == k) & (F.col("until").isNull() | (F.col("until") > F.col("batch")))).select(F.col("batch").alias(f"from{k}"), F.col("until").alias(f"until{k}"), F.col("key").alias(f"slot_{k}")))  # logarithmic in the stream's length
        out = out.join(own, (F.col("batch") >= F.col(f"from{k}")) & (F.col(f"until{k}").isNull() | (F.col("batch") < F.col(f"until{k}"))), "left").drop(f"from{k}", f"until{k}")
    return out.select("batch", F.col("end").alias("seq"), *[f"slot_{k}" for k in shown])


def drawn_with_replacement(source: DataFrame, value: str, size: int, batches_: int, tag: str = "d1") -> DataFrame:
    """(batch, seq, value): a simulated stream of ``batches_`` batches of ``size`` uniform draws, with replacement, from the rows of ``source``.

    Draw n takes the row whose number (in the order of ``value``) is a digest of n modulo the number of rows. An empty
    source gives an empty stream.
    """
    numbered = dense_index(source.select(F.col(value).alias("value")), "value")
    n = numbered.count()
    if not n:
        return source.sparkSession.createDataFrame([], f"batch bigint, seq bigint, value {source.schema[value].dataType.simpleString()}")
    seq = source.sparkSession.range(1, size * batches_ + 1).withColumnRenamed("id", "seq")
    draws = seq.select(F.floor((F.col("seq") - 1) / size).cast("bigint").alias("batch"), "seq", F.pmod(digest_number(tag, F.col("seq")), F.lit(n)).alias("idx"))
    return draws.join(numbered, "idx").select("batch", "seq", "value")


def bottom_k(stream: DataFrame, identity: str, k: int = 100, tag: str = "b1") -> DataFrame:
    """The k rows with the smallest digests of their identity: a uniform sample that merges by taking the smallest again."""
    d = F.md5(F.concat(F.lit(f"{tag}:"), F.col(identity).cast("string")))
    return stream.withColumn("_d", d).orderBy("_d", identity).limit(k).drop("_d")
