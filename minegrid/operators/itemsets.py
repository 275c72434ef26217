"""Frequent itemsets: baskets, level-wise joins, parallel pattern growth, and the two-pass scheme over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import clean_key, scope, written


def baskets(df: DataFrame, basket: str, item: str, more_than: int = 0) -> DataFrame:
    """Distinct (basket, item) rows with trimmed keys, of baskets with more than ``more_than`` items; rows without either key left out."""
    rows = df.select(clean_key(basket).alias("basket"), clean_key(item).alias("item")).where("basket is not null and item is not null").distinct()
    if more_than:
        rows = rows.join(rows.groupBy("basket").agg(F.count("*").alias("k")).where(F.col("k") > more_than).select("basket"), "basket", "left_semi")
    return rows


def basket_arrays(rows: DataFrame) -> DataFrame:
    return rows.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"))


def frequent_singletons(rows: DataFrame, support: int) -> DataFrame:
    return rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select(F.array("item").alias("items"), "n")


def frequent_itemsets(rows: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """(items, n) of all sets in at least ``support`` baskets, by levels.

    A level extends each basket's frequent (k-1)-sets by a later item with which every sub-pair is frequent and counts
    them; only occurrences of frequent sets go on, written once per level, so the work follows what is frequent.
    """
    single = written(frequent_singletons(rows, support), "level1")
    occ = written(rows.join(single.select(F.col("items")[0].alias("item")), "item", "left_semi"), "occ1")
    out, k, cur, pairs = single, 1, occ.select("basket", F.array("item").alias("items"), F.col("item").alias("last")), None
    while max_size is None or k < max_size:
        nxt = occ.withColumnRenamed("item", "more")
        ext = cur.join(nxt, "basket").where(F.col("more") > F.col("last"))
        if pairs is not None:
            ext = ext.join(pairs, ["last", "more"], "left_semi")
        ext = ext.select("basket", F.concat("items", F.array("more")).alias("items"), F.col("more").alias("last"))
        level = written(ext.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support), f"level{k + 1}")
        if level.isEmpty():
            break
        out = out.unionByName(level)
        k += 1
        if k == 2:
            pairs = level.select(F.col("items")[0].alias("last"), F.col("items")[1].alias("more"))
        if max_size is None or k < max_size:
            cur = written(ext.join(level.select("items"), "items", "left_semi"), f"occ{k}")
    return out


def frequent_by_growth(rows: DataFrame, support: int) -> DataFrame:
    """The same sets by parallel FP-growth, for long patterns: (items sorted, n)."""
    from pyspark.ml.fpm import FPGrowth

    arrays = basket_arrays(rows)
    n = arrays.count()
    if not n:
        return arrays.select("items", F.lit(0).cast("bigint").alias("n"))
    got = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / n), numPartitions=rows.sparkSession.sparkContext.defaultParallelism).fit(arrays).freqItemsets
    return got.select(F.sort_array("items").alias("items"), F.col("freq").alias("n"))


def local_candidates(rows: DataFrame, support: int, chunk: Column, max_size: int | None = 2) -> DataFrame:
    """First pass: sets of up to ``max_size`` items (None: of any size) frequent in some chunk at its scaled threshold ceil(support n_chunk / n).

    Items, baskets and sets go as numbers; a set is known by the number of its first items and its last item.
    """
    marked = rows.withColumn("chunk", chunk)
    sizes = marked.select("chunk", "basket").distinct().groupBy("chunk").agg(F.count("*").alias("m"))
    n = sizes.agg(F.sum("m").alias("total"))
    need = written(sizes.join(F.broadcast(n)).select("chunk", F.expr(f"(m * {support} + total - 1) div total").alias("need")), "need")
    names = written(rows.select("item").distinct().orderBy("item").withColumn("more", F.monotonically_increasing_id()), "item-numbers")  # sort as the items do
    numbers = marked.select("chunk", "basket").distinct().withColumn("b", F.monotonically_increasing_id())
    bought = written(marked.join(numbers, ["chunk", "basket"]).join(names, "item").select("chunk", "b", "more"), "bought")
    ext, out, k, single, sets, pairs = bought.select("chunk", "b", F.lit(-1).cast("bigint").alias("up"), "more"), None, 1, None, None, None
    while True:
        level = ext.groupBy("chunk", "up", "more").agg(F.count("*").alias("c")).join(need, "chunk").where("c >= need")
        level = written(level.select("chunk", "up", "more").withColumn("id", F.monotonically_increasing_id()), f"local{k}")
        begun = level.join(names, "more")
        begun = begun.select("id", F.array("item").alias("items")) if sets is None else begun.join(sets.withColumnRenamed("id", "up"), "up").select("id", F.concat("items", F.array("item")).alias("items"))
        sets = written(begun, f"sets{k}")
        out = sets.select("items") if out is None else out.unionByName(sets.select("items"))
        if k == max_size or level.isEmpty():
            return out.distinct()
        alive = written(ext.join(level, ["chunk", "up", "more"]).select("chunk", "b", F.col("id").alias("up"), F.col("more").alias("last")), f"alive{k}")
        if k == 1:
            single, first = alive.select("b", F.col("last").alias("more")), level.select(F.col("id").alias("up"), F.col("more").alias("last"))
        if k == 2:
            pairs = level.join(first, "up").select("chunk", "last", "more")
        ext = alive.join(single, "b").where(F.col("more") > F.col("last"))
        if pairs is not None:  # an extension can be frequent only where its last two items are
            ext = ext.join(pairs, ["chunk", "last", "more"], "left_semi")
        ext = ext.select("chunk", "b", "up", "more")
        k += 1


def count_candidates(rows: DataFrame, candidates: DataFrame, support: int) -> DataFrame:
    """Second pass: exact counts of the candidates over all baskets, those with at least ``support`` kept: (items, n).

    Level by level: an occurrence of a candidate's first items, frequent themselves, grows by its next one within the basket. Items and baskets go as numbers, a set as the number of its first items and its last.
    """
    c = written(candidates.select(F.sort_array("items").alias("items")).where(F.size("items") > 0).distinct(), "candidates")
    longest = c.agg(F.max(F.size("items"))).first()[0] or 0
    if not longest:
        return c.select("items", F.lit(0).cast("bigint").alias("n")).limit(0)
    starts = c.select(F.explode(F.sequence(F.lit(1), F.size("items"))).alias("k"), "items").select("k", F.slice("items", F.lit(1), F.col("k")).alias("items"))
    starts = starts.unionByName(c.select(F.lit(1).alias("k"), F.explode("items").alias("i")).select("k", F.array("i").alias("items"))).distinct()
    starts = written(starts.orderBy("k", "items").withColumn("id", F.monotonically_increasing_id()), "starts")  # numbers of items sort as the items do
    above = starts.select(F.col("items").alias("first"), F.col("id").alias("up"))
    tree = starts.where("k > 1").select("k", "id", F.slice("items", F.lit(1), F.col("k") - 1).alias("first"), F.element_at("items", -1).alias("item"))
    single = starts.where("k = 1").select("id", F.col("items")[0].alias("item"))
    tree = written(tree.join(above, "first").join(single.select("item", F.col("id").alias("more")), "item").select("k", "id", "up", "more"), "tree")
    bought = rows.join(rows.select("basket").distinct().withColumn("b", F.monotonically_increasing_id()), "basket")
    bought = written(bought.join(single, "item").select("b", "id"), "bought")
    found, cur = None, bought.withColumn("last", F.col("id"))
    with scope(keep=1):
        for k in range(1, longest + 1):
            n = written(cur.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= support), f"counts{k}")
            found = n if found is None else found.unionByName(n)
            if k < longest:
                live = cur.join(n.select("id"), "id", "left_semi").select("b", F.col("id").alias("up"), "last")
                if k == 1:
                    bought = live.select("b", F.col("last").alias("more"))
                ext = live.join(bought, "b").where("more > last").select("b", "up", "more")
                cur = written(ext.join(tree.where(F.col("k") == k + 1).select("up", "more", "id"), ["up", "more"]).select("b", "id", F.col("more").alias("last")), f"found{k + 1}")
        counts = written(found, "counts")
    return counts.join(starts.select("id", "items"), "id").join(c, "items", "left_semi").select("items", "n")
