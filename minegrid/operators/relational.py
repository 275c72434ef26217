"""Counts, averages, joins, top-k, unions and partition statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_count(df: DataFrame, text: str, delimiter: str = " ") -> DataFrame:
    """word, n over all texts split on a delimiter; empty words count, null texts don't."""
    return df.select(F.explode(F.split(text, delimiter)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, **cols: Column) -> DataFrame:
    """One row of distinct counts, nulls ignored. Each column is read and shuffled by itself; several in one aggregate would multiply the rows."""
    out = None
    for k, c in cols.items():
        one = df.select(c.alias("x")).where("x is not null").distinct().agg(F.count("*").alias(k))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys: count descending, key ascending; null keys left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def average_by(left: DataFrame, right: DataFrame, on: str, group: str, value: str, places: int = 6) -> DataFrame:
    """Average of ``value`` rows of ``right`` per ``group`` of ``left``; groups without any drop out; best first, then by name."""
    j = left.join(right, on, "left").where(F.col(value).isNotNull())
    return j.groupBy(group).agg(F.round(F.avg(value), places).alias(value)).orderBy(F.desc(value), F.asc(group))


def with_defaults(base: DataFrame, features: Sequence[DataFrame], on: str, default: float = 0.0) -> DataFrame:
    """Chained left joins; what a side lacks becomes the default."""
    out = base
    for f in features:
        cols = [c for c in f.columns if c != on]
        out = out.join(f, on, "left").withColumns({c: F.coalesce(c, F.lit(default)) for c in cols})
    return out


def tagged_union(tables: dict[str, DataFrame], tag: str = "table_name") -> DataFrame:
    """All rows of several tables with their table's name; columns a table lacks are null."""
    out = None
    for name, df in tables.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def measures(df: DataFrame, by: Sequence[str], sums: Sequence[str] = (), averages: Sequence[str] = (), places: int = 6) -> DataFrame:
    """Number of rows, sums and averages per group, as (by…, measure, value) rows."""
    aggs = [F.count("*").cast("double").alias("count_rows")]
    aggs += [F.round(F.sum(c).cast("double"), places).alias(f"sum_{c}") for c in sums]
    aggs += [F.round(F.avg(c), places).alias(f"avg_{c}") for c in averages]
    wide = df.groupBy(*by).agg(*aggs)
    names = [c for c in wide.columns if c not in by]
    return wide.unpivot(list(by), names, "measure", "value")


def bucket_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per bucket of a custom layout: the key's first character code modulo n."""
    return df.where(F.col(key).isNotNull()).groupBy(F.pmod(F.ascii(key), F.lit(n)).alias("bucket")).agg(F.count("*").alias("n"))


def laid_out(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows in n partitions, chosen by the key's first character code."""
    return df.repartitionById(n, F.pmod(F.ascii(F.coalesce(key, F.lit(""))), F.lit(n)).cast("int"))


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def zscores(df: DataFrame, cols: Sequence[str], places: int = 6, by: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sample standard deviation per column, statistics taken from ``by`` (training data) or ``df``; 0 where they don't vary."""
    stats = (by if by is not None else df).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    out = df.join(F.broadcast(stats))  # one row
    z = {c: F.round(F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).otherwise(0.0), places) for c in cols}
    return out.withColumns(z).select(*df.columns)


def dense_index(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx`` 0, 1, … in the order given, without gathering the rows in one task.

    Rows are range-partitioned and sorted; a partition's offset is the number of rows before it (one number per
    partition comes to the driver). Ties in the order are numbered in any sequence.
    """
    from ..util import written

    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    local = written(ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "ranked")
    sizes = sorted((r["_p"], r["n"]) for r in local.groupBy("_p").agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    if not offsets:
        return local.select(*df.columns, F.lit(0).cast("bigint").alias("idx"))
    off = df.sparkSession.createDataFrame(offsets, "_p int, _o bigint")
    return local.join(F.broadcast(off), "_p").select(*df.columns, (F.col("_o") + F.col("_r") - 1).alias("idx"))  # one row per partition


def rmse(df: DataFrame, predicted: str, truth: str, places: int = 6) -> DataFrame:
    return df.agg(F.round(F.sqrt(F.avg((F.col(predicted) - F.col(truth)) ** 2)), places).alias("rmse"), F.count("*").alias("n"))


def error_histogram(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Absolute errors in [0,1), [1,2), [2,3), [3,4), [4,…): bin 0 to 4, n."""
    b = F.least(F.floor(F.abs(F.col(predicted) - F.col(truth))), F.lit(4)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def precision_recall(found: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """n_found, n_true, n_both, precision, recall of two sets of rows; 0 where undefined."""
    f, t = found.select(*on).distinct().withColumn("f", F.lit(1)), truth.select(*on).distinct().withColumn("t", F.lit(1))
    s = f.join(t, list(on), "full").agg(F.count("f").alias("n_found"), F.count("t").alias("n_true"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("n_both"))
    return s.withColumn("precision", F.when(F.col("n_found") > 0, F.col("n_both") / F.col("n_found")).otherwise(0.0)).withColumn("recall", F.when(F.col("n_true") > 0, F.col("n_both") / F.col("n_true")).otherwise(0.0))


def mutual_information(df: DataFrame, truth: str, label: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean of the entropies) of two labellings: one row ``nmi``; 1 if both are constant."""
    cell = df.groupBy(truth, label).agg(F.count("*").alias("c"))
    n = cell.agg(F.sum("c").alias("n"))
    a, b = cell.groupBy(truth).agg(F.sum("c").alias("ca")), cell.groupBy(label).agg(F.sum("c").alias("cb"))
    mi = cell.join(a, truth).join(b, label).join(F.broadcast(n)).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))).alias("mi"))
    ha = a.join(F.broadcast(n)).agg(F.sum(-F.col("ca") / F.col("n") * F.log(F.col("ca") / F.col("n"))).alias("ha"))
    hb = b.join(F.broadcast(n)).agg(F.sum(-F.col("cb") / F.col("n") * F.log(F.col("cb") / F.col("n"))).alias("hb"))
    return mi.join(F.broadcast(ha)).join(F.broadcast(hb)).select(F.when(F.col("ha") + F.col("hb") > 0, F.round(2 * F.col("mi") / (F.col("ha") + F.col("hb")), 6)).otherwise(1.0).alias("nmi"))
