"""Queries on quality (recall, agreement of clusterings) and round trips through the sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import graph as G
from ..operators import itemsets as I
from ..operators import relational as rel
from ..operators import similarity as S
from ..sources import readers, writers
from ..util import new_dir, table, written
from . import registry as base
from .registry import _BLANK, _GRAPH, _LEVELS, _PATHS, _REPS, _SETS, _SMALL, _SYM, COMMON, SUPPORT, _key, _lpa, _rows

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- quality ----------------------------------------------------------------------------------------------------

_EXACT = f"""WITH {_SETS}, {_REPS}, j AS (SELECT x.r AS a, y.r AS b, count(*) AS i FROM o x JOIN o y ON y.m = x.m AND x.r < y.r GROUP BY 1, 2),
    ex AS (SELECT a, b, round(CAST(i AS DOUBLE) / (ea.n + eb.n - i), 6) AS similarity FROM j JOIN e ea ON ea.r = a JOIN e eb ON eb.r = b WHERE 2 * i >= ea.n + eb.n - i)"""


def _representatives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = written(S.set_rows(table(spark, d, "yelp_train"), "business_id", "user_id"), "set-rows")
    reps = written(S.set_classes(rows).where("record = rep").select("record", "size"), "reps")
    return written(rows.join(reps.select("record"), "record", "left_semi"), "rep-rows"), reps


@_query(_EXACT + " SELECT a, b, similarity FROM ex")
def exact_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.exact_similar(*_representatives(spark, d))


@_query(base.ORACLES["lsh_jaccard_pairs"].replace("SELECT a, b, round(CAST(i AS DOUBLE) / (ea.n + eb.n - i), 6) AS similarity FROM j", ", ls AS (SELECT a, b FROM j").strip() + f"""),
    xj AS (SELECT x.r AS a, y.r AS b, count(*) AS i FROM o x JOIN o y ON y.m = x.m AND x.r < y.r GROUP BY 1, 2),
    ex AS (SELECT a, b FROM xj JOIN e ea ON ea.r = a JOIN e eb ON eb.r = b WHERE 2 * i >= ea.n + eb.n - i),
    c AS (SELECT (SELECT count(*) FROM ls) AS n_found, (SELECT count(*) FROM ex) AS n_true, (SELECT count(*) FROM ls JOIN ex USING (a, b)) AS n_both)
    SELECT *, CASE WHEN n_found > 0 THEN n_both / n_found ELSE 0.0 END AS precision, CASE WHEN n_true > 0 THEN n_both / n_true ELSE 0.0 END AS recall FROM c""")
def lsh_quality(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the banded join against the exact one."""
    own, reps = _representatives(spark, d)
    found = S.verified(S.lsh_candidates(S.minhash_signatures(own)), own, reps)
    return rel.precision_recall(written(found, "found"), written(S.exact_similar(own, reps), "exact"), ["a", "b"])


_LATE = "2014-01-16"


@_query(
    f"""WITH f AS (SELECT avg(review_count) AS m1, stddev_samp(review_count) AS s1, avg(average_stars) AS m2, stddev_samp(average_stars) AS s2 FROM yelp_user WHERE arrived_at < TIMESTAMP '{_LATE}')
    SELECT arrival_no, round((review_count - m1) / s1, 5) AS review_count, round((average_stars - m2) / s2, 5) AS average_stars FROM yelp_user, f WHERE arrived_at >= TIMESTAMP '{_LATE}'"""
)
def zscore_of_later(spark: SparkSession, d: str) -> DataFrame:
    """Later rows scaled by the mean and spread of the earlier ones."""
    u = table(spark, d, "yelp_user").select("arrival_no", "arrived_at", F.col("review_count").cast("double").alias("review_count"), "average_stars")
    late = F.col("arrived_at") >= F.lit(_LATE).cast("timestamp")
    return rel.zscores(u.where(late).drop("arrived_at"), ["review_count", "average_stars"], 5, by=u.where(~late))


@_query(
    f"""WITH a AS ({base.ORACLES['mahalanobis_assign'].replace('WITH ', 'SELECT * FROM (WITH ', 1)})), l AS (SELECT label AS t, cluster AS k FROM embeddings JOIN a USING (vec_id)),
    c AS (SELECT t, k, CAST(count(*) AS DOUBLE) AS c FROM l GROUP BY 1, 2), n AS (SELECT sum(c) AS n FROM c), x AS (SELECT t, sum(c) AS ct FROM c GROUP BY 1), y AS (SELECT k, sum(c) AS ck FROM c GROUP BY 1),
    mi AS (SELECT sum(c / n * ln(c * n / (ct * ck))) AS mi FROM c JOIN x USING (t) JOIN y USING (k), n), hx AS (SELECT sum(-ct / n * ln(ct / n)) AS h FROM x, n), hy AS (SELECT sum(-ck / n * ln(ck / n)) AS h FROM y, n)
    SELECT CASE WHEN hx.h + hy.h > 0 THEN round(2 * mi / (hx.h + hy.h), 6) ELSE 1.0 END AS nmi FROM mi, hx, hy"""
)
def assignment_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Normalised mutual information of the true labels and the nearest summaries."""
    e = table(spark, d, "embeddings")
    s = C.summaries_of(e.select("label", F.col("embedding").alias("features")))
    got = written(C.nearest_cluster(e, "vec_id", "embedding", sorted(s.items())).withColumnRenamed("index", "vec_id").join(e.select("vec_id", "label"), "vec_id"), "assigned")
    return rel.mutual_information(got, "label", "cluster")


@_query()
def bfr_quality(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the memory-bounded clustering with the true labels, and the share of points in its discard sets."""
    e = table(spark, d, "embeddings")
    k = e.select("label").distinct().count()
    b = C.bfr(e, "vec_id", "embedding", k)
    got = written(b.labels().join(e.select(F.col("vec_id").alias("index"), F.col("label").alias("truth")), "index"), "labelled")
    kept = b.stats(spark).orderBy(F.desc("round")).limit(1).select((F.col("ds_points") / (F.col("ds_points") + F.col("cs_points") + F.col("rs_points"))).alias("discard_share"))
    return rel.mutual_information(got, "truth", "label").join(F.broadcast(kept))  # one row each


# ---- round trips: what is written is read again ------------------------------------------------------------------


@_query(f"SELECT user_id, business_id, count(*) AS n, sum(stars) AS stars FROM yelp_train WHERE user_id <> '' AND business_id <> '' AND user_id = {_key('user_id')} AND business_id = {_key('business_id')} GROUP BY 1, 2")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ratings through a CSV file with a header."""
    to = new_dir(spark, "csv")
    t = table(spark, d, "yelp_train").select("user_id", "business_id", "stars")
    clean = t.where("user_id <> '' and business_id <> ''").where((F.col("user_id") == base.clean_key("user_id")) & (F.col("business_id") == base.clean_key("business_id")))
    writers.write_csv(clean, to)
    return readers.read_csv(spark, to, "rating").groupBy("user_id", "business_id").agg(F.count("*").alias("n"), F.sum("stars").alias("stars"))


@_query("SELECT city, count(*) AS n, count(address) AS with_address, sum(coalesce(cardinality(attributes), 0)) AS n_attributes, round(sum(stars), 4) AS stars FROM business GROUP BY 1")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Businesses with their maps through JSON lines."""
    to = new_dir(spark, "json")
    table(spark, d, "business").drop("listed_at", "deleted_at").write.json(to)
    b = readers.read_json(spark, to, "business")
    return b.groupBy("city").agg(F.count("*").alias("n"), F.count("address").alias("with_address"), F.sum(F.coalesce(F.size("attributes"), F.lit(0)).cast("bigint")).alias("n_attributes"), F.round(F.sum("stars"), 4).alias("stars"))


@_query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(replace(replace(name, chr(10), ' '), chr(13), ' '), ' ')) AS word FROM business WHERE name IS NOT NULL) GROUP BY 1")
def text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Words of lines of a text file."""
    to = new_dir(spark, "text")
    table(spark, d, "business").where("name is not null").select(F.translate("name", "\n\r", "  ").alias("value")).write.text(to)
    return rel.word_count(readers.read_lines(spark, to), "value")


@_query("SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey AS basket, CAST(l_partkey AS VARCHAR) AS product, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def transactions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Quoted retail rows by position, product numbers without their leading zeros."""
    to = new_dir(spark, "transactions")
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("D"), F.col("o_custkey").alias("C"), F.lit("x").alias("a"), F.lit("y, z").alias("b"), F.lit(1).alias("c"), F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("P"))
    j.write.option("header", True).option("quoteAll", True).csv(to)
    return readers.read_transactions(spark, to).groupBy("basket", "product").agg(F.count("*").alias("n"))


@_query("SELECT vec_id AS index, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) + 0.0 AS total FROM embeddings")
def vectors_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Headerless numeric lines: index, label, coordinates."""
    to = new_dir(spark, "vectors")
    line = F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ","))
    table(spark, d, "embeddings").select(line.alias("value")).write.text(to)
    v = readers.read_vectors(spark, to)
    return v.select("index", F.size("features").cast("bigint").alias("n"), (F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 3) + F.lit(0.0)).alias("total"))


@_query("SELECT table_name, count(*) AS n, count(name) AS with_name, count(user_id) AS with_user FROM (SELECT 'business' AS table_name, name, NULL AS user_id FROM business UNION ALL SELECT 'review', NULL, user_id FROM yelp_train) GROUP BY 1")
def union_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two JSON files of different kinds as one tagged table."""
    b, r = new_dir(spark, "union-b"), new_dir(spark, "union-r")
    table(spark, d, "business").select("business_id", "name").write.json(b)
    table(spark, d, "yelp_train").select("business_id", "user_id", "stars").write.json(r)
    u = readers.read_union(spark, {"business": b, "review": r}, {"business": "business", "review": "review"})
    return u.groupBy("table_name").agg(F.count("*").alias("n"), F.count("name").alias("with_name"), F.count("user_id").alias("with_user"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_lines(spark, path).where("value <> ''").select("value")


_QUOTE = "'(''' || replace(items, ' ', ''', ''') || ''')'"


@_query(
    f"""WITH RECURSIVE {_SMALL}, {_LEVELS}, li AS (SELECT size, string_agg({_QUOTE}, ',' ORDER BY string_split(items, ' ')) AS value FROM fs GROUP BY 1)
    SELECT 'Candidates:' AS value UNION ALL SELECT 'Frequent Itemsets:' UNION ALL SELECT value FROM li UNION ALL SELECT value FROM li"""
)
def itemset_report(spark: SparkSession, d: str) -> DataFrame:
    """The two-section text report of the frequent sets (as both candidates and results), read again."""
    sets = written(I.frequent_itemsets(_rows(spark, d), SUPPORT), "sets")
    to = new_dir(spark, "report")
    writers.write_itemset_report(sets, sets, to)
    return _lines(spark, to)


@_query(f"WITH {_GRAPH}, {_SYM}, {_lpa(5)} SELECT '''' || string_agg(id, ''', ''' ORDER BY id) || '''' AS value FROM l5 GROUP BY label")
def community_report(spark: SparkSession, d: str) -> DataFrame:
    to = new_dir(spark, "report")
    writers.write_communities(G.communities(G.label_propagation(G.cooccurrence_edges(_rows(spark, d), "item", "basket", COMMON))), to)
    return _lines(spark, to)


@_query(
    f"""WITH RECURSIVE {_GRAPH}, {_SYM}, {_PATHS}, bt AS (SELECT least(s, t) AS u, greatest(s, t) AS v, sum(x.p * y.p / z.p) / 2 AS b
    FROM sy JOIN sg x ON x.n = s JOIN sg y ON y.n = t JOIN sg z ON z.r = x.r AND z.n = y.r AND z.d = x.d + 1 + y.d GROUP BY 1, 2) SELECT u, v, round(b, 3) AS betweenness FROM bt"""
)
def betweenness_report(spark: SparkSession, d: str) -> DataFrame:
    """The text report of edge betweenness, parsed again."""
    to = new_dir(spark, "report")
    writers.write_betweenness(G.edge_betweenness(G.cooccurrence_edges(_rows(spark, d), "item", "basket", COMMON)), to)
    p = r"\('(.*)', '(.*)'\),(.*)"
    return _lines(spark, to).select(F.regexp_extract("value", p, 1).alias("u"), F.regexp_extract("value", p, 2).alias("v"), F.round(F.regexp_extract("value", p, 3).cast("double"), 3).alias("betweenness"))


@_query("SELECT vec_id AS index, label FROM embeddings")
def clustering_report(spark: SparkSession, d: str) -> DataFrame:
    """The clustering report (here of the true labels under one round line), parsed again."""
    to = new_dir(spark, "report")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("index"), "label")
    rounds = spark.createDataFrame([(1, 1, 0, 0, 0)], "round int, ds_points bigint, cs_clusters bigint, cs_points bigint, rs_points bigint")
    writers.write_clustering_report(rounds, e, to)
    two = F.split("value", ",")
    return _lines(spark, to).where(F.size(two) == 2).select(two[0].cast("bigint").alias("index"), two[1].cast("bigint").alias("label"))


@_query(base.ORACLES["exploration_report"])
def json_object_report(spark: SparkSession, d: str) -> DataFrame:
    """The exploration as one JSON object in a file, read again."""
    to = new_dir(spark, "report")
    r = base.exploration_report(spark, d)
    writers.write_json_object(r, to)
    return spark.read.schema(r.schema).json(to)
