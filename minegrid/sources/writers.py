"""Writers of the result formats. Each takes a DataFrame and a path; files are made by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_object(df: DataFrame, path: str) -> None:
    """A one-row result as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def _text(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions(*[c for c in lines.columns if c != "value"]).select("value").write.mode("overwrite").text(path)


def itemset_lines(sets: DataFrame, items: str = "items") -> DataFrame:
    """(n, value): per size one line ``('a'),('b')`` or ``('a', 'b'),…``, sets in order."""
    shown = F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))
    one = sets.select(F.size(items).alias("n"), F.col(items).alias("i"), shown.alias("s"))
    return one.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), ",").alias("value"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """The two-section report as ordered lines (section, n, part, value); a blank line follows each size."""
    spark = candidates.sparkSession
    parts = []
    for k, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        parts.append(spark.createDataFrame([(k, 0, 0, title)], "section int, n int, part int, value string"))
        lines = itemset_lines(sets)
        parts.append(lines.select(F.lit(k).alias("section"), "n", F.lit(0).alias("part"), "value"))
        parts.append(lines.select(F.lit(k).alias("section"), "n", F.lit(1).alias("part"), F.lit("").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    _text(itemset_report(candidates, frequent), path)


def community_lines(communities: DataFrame) -> DataFrame:
    """(size, members, value): one line of quoted members each, smallest first."""
    return communities.select(F.size("members").alias("size"), "members", F.concat(F.lit("'"), F.array_join("members", "', '"), F.lit("'")).alias("value"))


def write_communities(communities: DataFrame, path: str) -> None:
    _text(community_lines(communities), path)


def betweenness_lines(edges: DataFrame) -> DataFrame:
    return edges.select((-F.col("betweenness")).alias("k"), "u", "v", F.format_string("('%s', '%s'),%s", F.col("u").cast("string"), F.col("v").cast("string"), F.col("betweenness").cast("string")).alias("value"))


def write_betweenness(edges: DataFrame, path: str) -> None:
    _text(betweenness_lines(edges), path)


def write_clustering_report(rounds: DataFrame, labels: DataFrame, path: str) -> None:
    """Round lines ``ds,cs_clusters,cs_points,rs``, a blank line, then ``index,label``."""
    head = rounds.select(F.lit(0).alias("a"), F.col("round").cast("bigint").alias("b"), F.concat_ws(",", "ds_points", "cs_clusters", "cs_points", "rs_points").alias("value"))
    gap = rounds.sparkSession.createDataFrame([(1, 0, "")], "a int, b bigint, value string")
    tail = labels.select(F.lit(2).alias("a"), F.col("index").cast("bigint").alias("b"), F.concat_ws(",", "index", "label").alias("value"))
    _text(head.unionByName(gap).unionByName(tail), path)


def show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def partition_report(df: DataFrame) -> DataFrame:
    """Rows per physical partition, empty ones included: partition, n."""
    n = df.rdd.getNumPartitions()
    have = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition")).join(have, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n")).orderBy("partition")
