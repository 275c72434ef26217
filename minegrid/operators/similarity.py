"""MinHash signatures, banding and exact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_family, linear_hash
from ..util import clean_key, written
from .relational import dense_index

PRIME = 2147483647


def set_rows(df: DataFrame, record: str, member: str) -> DataFrame:
    """Distinct (record, member) with trimmed keys; rows without either left out."""
    return df.select(clean_key(record).alias("record"), clean_key(member).alias("member")).where("record is not null and member is not null").distinct()


def set_classes(rows: DataFrame) -> DataFrame:
    """(record, rep, size): records with equal sets share the smallest record as representative."""
    prints = rows.groupBy("record").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("member")).alias("x1"), F.bit_xor(F.xxhash64("member", F.lit(7))).alias("x2"))
    reps = prints.groupBy("size", "x1", "x2").agg(F.min("record").alias("rep"))
    return prints.join(reps, ["size", "x1", "x2"]).select("record", "rep", "size")


def minhash_signatures(rows: DataFrame, hashes: int = 50, seed: int = 1) -> DataFrame:
    """(record, signature): per hash the minimum of ((a i + b) mod p) mod (n + 1) over the members' dense indexes i (n members in all).

    One aggregation with a minimum per hash; members are never multiplied by the number of hashes.
    """
    members = dense_index(rows.select("member").distinct(), "member")
    n = members.count()
    x = F.col("idx")
    mins = [F.min(linear_hash(x, a, b, PRIME, n + 1)).alias(f"h{k}") for k, (a, b) in enumerate(hash_family(hashes, PRIME, seed))]
    return rows.join(members, "member").groupBy("record").agg(*mins).select("record", F.array(*[f"h{k}" for k in range(hashes)]).alias("signature"))


def lsh_candidates(signatures: DataFrame, rows_per_band: int = 2) -> DataFrame:
    """Distinct pairs a < b that agree in all rows of some band. Give it representatives of equal sets only, so copies don't meet."""
    bands = signatures.select("record", F.expr(f"explode(transform(sequence(0, size(signature) div {rows_per_band} - 1), b -> struct(b as band, slice(signature, b * {rows_per_band} + 1, {rows_per_band}) as k)))").alias("x")).select("record", "x.band", "x.k")
    l, r = bands.select("band", "k", F.col("record").alias("a")), bands.select("band", "k", F.col("record").alias("b"))
    return l.join(r, ["band", "k"]).where("a < b").select("a", "b").distinct()


def verified(pairs: DataFrame, rows: DataFrame, sizes: DataFrame, threshold: float = 0.5, places: int = 6) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact Jaccard reaches the threshold."""
    sa, sb = sizes.select(F.col("record").alias("a"), F.col("size").alias("na")), sizes.select(F.col("record").alias("b"), F.col("size").alias("nb"))
    # the smaller set brings its members, so a huge one isn't copied for each of its partners
    first = F.col("na") <= F.col("nb")
    p = pairs.join(sa, "a").join(sb, "b").select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("l"))
    both = p.join(rows.select(F.col("record").alias("s"), "member"), "s").join(rows.select(F.col("record").alias("l"), "member"), ["l", "member"])
    inter = both.groupBy("a", "b").agg(F.count("*").alias("i"))
    j = inter.join(sa, "a").join(sb, "b").withColumn("s", F.col("i") / (F.col("na") + F.col("nb") - F.col("i")))
    return j.where(F.col("s") >= threshold).select("a", "b", F.round("s", places).alias("similarity"))


def lsh_similar(df: DataFrame, record: str, member: str, threshold: float = 0.5, hashes: int = 50, rows_per_band: int = 2, seed: int = 1) -> DataFrame:
    """Pairs of representatives whose signatures meet in a band and whose exact similarity reaches the threshold."""
    rows = written(set_rows(df, record, member), "set-rows")
    reps = written(set_classes(rows).where("record = rep").select("record", "size"), "reps")
    own = written(rows.join(reps.select("record"), "record", "left_semi"), "rep-rows")
    return verified(lsh_candidates(minhash_signatures(own, hashes, seed), rows_per_band), own, reps, threshold)


def exact_similar(rows: DataFrame, sizes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity), a < b, of all records whose Jaccard reaches the threshold: the yardstick for the banded join.

    Two such sets share one of the first size - ceil(t size) + 1 members of each, rare ones first, and sizes within t of
    each other; what meets there is verified. Rows with more meetings than that are never made.
    """
    freq = rows.groupBy("member").agg(F.count("*").alias("f"))
    order = Window.partitionBy("record").orderBy("f", "member")
    cut = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    pre = rows.join(freq, "member").join(sizes, "record").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cut)
    pre = written(pre.select("record", "member", "size"), "prefixes")
    l, r = pre.select(F.col("record").alias("a"), "member", F.col("size").alias("na")), pre.select(F.col("record").alias("b"), "member", F.col("size").alias("nb"))
    near = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    met = l.join(r, "member").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return verified(met, rows, sizes, threshold)
