"""Registry of the mining and analytics queries with their SQL; every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SCORED_ATTRIBUTES, hash_family
from ..operators import boosting as B
from ..operators import clustering as C
from ..operators import graph as G
from ..operators import itemsets as I
from ..operators import recommend as R
from ..operators import relational as rel
from ..operators import similarity as S
from ..streaming import sketches as K
from ..util import clean_key, table, written

QUERIES: dict = {}
ORACLES: dict = {}
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _key(col: str) -> str:
    return f"nullif(trim({col}, {_BLANK}), '')"


# ---- exploration ------------------------------------------------------------------------------------------------


@_query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return rel.word_count(table(spark, d, "documents"), "text")


@_query(
    "SELECT count(DISTINCT row_no) AS n_review, count(DISTINCT row_no) FILTER (strftime(rated_at, '%Y-%m-%d') LIKE '2014%') AS n_review_2014,"
    " count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business FROM yelp_train"
)
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    in_2014 = F.date_format("rated_at", "yyyy-MM-dd").startswith("2014")
    return rel.distinct_counts(table(spark, d, "yelp_train"), n_review=F.col("row_no"), n_review_2014=F.when(in_2014, F.col("row_no")), n_user=F.col("user_id"), n_business=F.col("business_id"))


@_query("SELECT user_id, count(*) AS n FROM yelp_train WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top10_users(spark: SparkSession, d: str) -> DataFrame:
    return rel.top_k(table(spark, d, "yelp_train"), "user_id")


@_query("SELECT business_id, count(*) AS n FROM yelp_train WHERE business_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, business_id LIMIT 10")
def top10_items(spark: SparkSession, d: str) -> DataFrame:
    return rel.top_k(table(spark, d, "yelp_train"), "business_id")


def _top(col: str) -> str:
    return f"(SELECT string_agg(k || ':' || n, ' ' ORDER BY n DESC, k) FROM (SELECT {col} AS k, count(*) AS n FROM yelp_train WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY n DESC, k LIMIT 10))"


@_query(
    "SELECT count(DISTINCT row_no) AS n_review, count(DISTINCT row_no) FILTER (strftime(rated_at, '%Y-%m-%d') LIKE '2014%') AS n_review_2014, count(DISTINCT user_id) AS n_user,"
    f" count(DISTINCT business_id) AS n_business, {_top('user_id')} AS top10_user, {_top('business_id')} AS top10_business FROM yelp_train"
)
def exploration_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole exploration as one object: four distinct counts and both top lists."""
    t = table(spark, d, "yelp_train")
    out = distinct_counts(spark, d)
    for col, name in (("user_id", "top10_user"), ("business_id", "top10_business")):
        top = rel.top_k(t, col).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(col).alias("k")))).alias("x"))
        out = out.join(F.broadcast(top.select(F.array_join(F.transform("x", lambda r: F.concat(r["k"], F.lit(":"), (-r["m"]).cast("string"))), " ").alias(name))))  # one row
    return out


@_query("SELECT strftime(rated_at, '%Y') AS year, count(*) AS n FROM yelp_train WHERE rated_at IS NOT NULL GROUP BY 1")
def count_by_year_prefix(spark: SparkSession, d: str) -> DataFrame:
    y = F.substring(F.date_format("rated_at", "yyyy-MM-dd HH:mm:ss"), 1, 4)
    return table(spark, d, "yelp_train").where("rated_at is not null").groupBy(y.alias("year")).agg(F.count("*").alias("n"))


@_query(
    "SELECT b.city, round(avg(t.stars), 6) AS stars FROM business b JOIN yelp_train t ON b.business_id = t.business_id WHERE t.stars IS NOT NULL GROUP BY 1"
)
def group_avg_after_left_join(spark: SparkSession, d: str) -> DataFrame:
    b, t = table(spark, d, "business").select("business_id", "city"), table(spark, d, "yelp_train").select("business_id", "stars")
    return rel.average_by(b, t, "business_id", "city", "stars")


@_query(
    "SELECT c_custkey, coalesce(round(v, 4), 0.0) AS order_var, coalesce(CAST(n AS DOUBLE), 0.0) AS n_orders FROM customer LEFT JOIN"
    " (SELECT o_custkey, var_pop(o_totalprice / 100000) AS v, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"
)
def left_join_defaults(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.var_pop(F.col("o_totalprice") / 100000), 4).alias("order_var"), F.count("*").cast("double").alias("n_orders"))
    return rel.with_defaults(table(spark, d, "customer").select("c_custkey"), [v], "c_custkey")


@_query(
    f"""WITH b AS (SELECT DISTINCT {_key('business_id')} AS k FROM business), v AS (SELECT {_key('business_id')} AS k, round(var_pop(stars) + 1e-9, 6) AS v FROM yelp_train GROUP BY 1),
    p AS (SELECT {_key('business_id')} AS k, count(*) AS n FROM documents WHERE source IS DISTINCT FROM 'menu' GROUP BY 1), s AS (SELECT {_key('business_id')} AS k, count(*) AS m FROM yelp_train GROUP BY 1)
    SELECT b.k AS business_id, coalesce(v, 0.0) AS star_var, coalesce(CAST(n AS DOUBLE), 0.0) AS n_texts, coalesce(CAST(m AS DOUBLE), 0.0) AS n_ratings
    FROM b LEFT JOIN v ON v.k = b.k LEFT JOIN p ON p.k = b.k LEFT JOIN s ON s.k = b.k WHERE b.k IS NOT NULL"""
)
def chained_left_joins(spark: SparkSession, d: str) -> DataFrame:
    key = clean_key("business_id").alias("business_id")
    t = table(spark, d, "yelp_train")
    texts = table(spark, d, "documents").where(~F.col("source").eqNullSafe("menu")).groupBy(key).agg(F.count("*").cast("double").alias("n_texts"))
    sides = [t.groupBy(key).agg(F.round(F.var_pop("stars") + 1e-9, 6).alias("star_var")), texts, t.groupBy(key).agg(F.count("*").cast("double").alias("n_ratings"))]
    return rel.with_defaults(table(spark, d, "business").select(key).where("business_id is not null").distinct(), sides, "business_id")


@_query("SELECT round(avg(review_count), 6) AS review_count, round(avg(fans), 6) AS fans, round(avg(average_stars), 6) AS average_stars, round(avg(useful + funny + cool), 6) AS social FROM yelp_user")
def global_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "yelp_user").agg(*[F.round(F.avg(c), 6).alias(n) for n, c in (("review_count", "review_count"), ("fans", "fans"), ("average_stars", "average_stars"), ("social", F.expr("useful + funny + cool")))])


@_query("SELECT business_id, round(var_pop(stars) + 1e-9, 6) AS star_var FROM yelp_train WHERE stars IS NOT NULL GROUP BY 1")
def var_pop_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "yelp_train").where("stars is not null").groupBy("business_id").agg(F.round(F.var_pop("stars") + 1e-9, 6).alias("star_var"))


@_query("SELECT home_city, sum(useful) AS useful, sum(compliment_hot) AS hot FROM yelp_user GROUP BY 1")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "yelp_user").groupBy("home_city").agg(F.sum("useful").alias("useful"), F.sum("compliment_hot").alias("hot"))


@_query(
    "SELECT table_name, count(*) AS n, count(business_id) AS with_business, count(stars) AS with_stars FROM (SELECT business_id, stars, 'yelp_train' AS table_name FROM yelp_train"
    " UNION ALL SELECT business_id, NULL, 'documents' FROM documents UNION ALL SELECT business_id, stars, 'business' FROM business) GROUP BY 1"
)
def tagged_union(spark: SparkSession, d: str) -> DataFrame:
    u = rel.tagged_union({"yelp_train": table(spark, d, "yelp_train").select("business_id", "stars"), "documents": table(spark, d, "documents").select("business_id"), "business": table(spark, d, "business").select("business_id", "stars")})
    return u.groupBy("table_name").agg(F.count("*").alias("n"), F.count("business_id").alias("with_business"), F.count("stars").alias("with_stars"))


@_query(
    """WITH g AS (SELECT city, CAST(count(*) AS DOUBLE) AS count_rows, CAST(sum(review_count) AS DOUBLE) AS sum_review_count, round(CAST(sum(stars) AS DOUBLE), 6) AS sum_stars, round(avg(stars), 6) AS avg_stars FROM business GROUP BY 1)
    SELECT city, 'count_rows' AS measure, count_rows AS value FROM g UNION ALL SELECT city, 'sum_review_count', sum_review_count FROM g
    UNION ALL SELECT city, 'sum_stars', sum_stars FROM g UNION ALL SELECT city, 'avg_stars', avg_stars FROM g"""
)
def measures_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rel.measures(table(spark, d, "business"), ["city"], ["review_count", "stars"], ["stars"])


@_query("SELECT city, business_id, round(avg(stars), 6) AS avg_stars, round(sum(stars), 6) AS sum_stars FROM business GROUP BY 1, 2")
def average_and_sum_by_city(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "business").groupBy("city", "business_id").agg(F.round(F.avg("stars"), 6).alias("avg_stars"), F.round(F.sum("stars"), 6).alias("sum_stars")).orderBy(F.desc("avg_stars"))


@_query("SELECT CAST(ascii(business_id) % 7 AS INTEGER) AS bucket, count(*) AS n FROM yelp_train WHERE business_id IS NOT NULL GROUP BY 1")
def partition_counts_by_first_char(spark: SparkSession, d: str) -> DataFrame:
    return rel.bucket_counts(table(spark, d, "yelp_train"), "business_id", 7)


@_query()
def partition_report(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.writers import partition_report as report

    t = table(spark, d, "yelp_train").select("business_id")
    return report(t).withColumn("layout", F.lit("default")).unionByName(report(rel.laid_out(t, "business_id", 7)).withColumn("layout", F.lit("custom")))


@_query("SELECT DISTINCT user_id FROM yelp_train t WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM yelp_user u WHERE u.user_id = t.user_id)")
def users_not_delivered(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "yelp_train").select("user_id").where("user_id is not null").distinct()
    return rel.anti(t, table(spark, d, "yelp_user").where("user_id is not null"), "user_id")


@_query(
    "SELECT arrival_no, round((review_count - (SELECT avg(review_count) FROM yelp_user)) / (SELECT stddev_samp(review_count) FROM yelp_user), 5) AS review_count,"
    " round((average_stars - (SELECT avg(average_stars) FROM yelp_user)) / (SELECT stddev_samp(average_stars) FROM yelp_user), 5) AS average_stars FROM yelp_user"
)
def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "yelp_user").select("arrival_no", F.col("review_count").cast("double").alias("review_count"), "average_stars")
    return rel.zscores(u, ["review_count", "average_stars"], 5)


# ---- frequent itemsets ------------------------------------------------------------------------------------------

#: Support of the itemset queries. The groups bought together don't grow with the number of baskets, so a share of them would lose these.
SUPPORT = 12

_SMALL = f"s AS (SELECT DISTINCT {_key('user_id')} AS u, {_key('business_id')} AS i FROM small1), b AS (SELECT u, i FROM s WHERE u IS NOT NULL AND i IS NOT NULL)"
# occurrences of frequent sets, level by level until there are none
_LEVELS = f"""fr AS (SELECT i FROM b GROUP BY 1 HAVING count(*) >= {SUPPORT}), fb AS (SELECT u, i FROM b JOIN fr USING (i)),
    oc AS (SELECT 1 AS size, u, i AS items, i AS last FROM fb UNION ALL SELECT size + 1, oc.u, items || ' ' || fb.i, fb.i FROM oc JOIN fb ON fb.u = oc.u AND fb.i > last
    QUALIFY count(*) OVER (PARTITION BY items || ' ' || fb.i) >= {SUPPORT}), fs AS (SELECT size, items, count(*) AS n FROM oc GROUP BY 1, 2)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Baskets of items per user."""
    return written(I.baskets(table(spark, d, "small1"), "user_id", "business_id"), "baskets")


def _shown(sets: DataFrame) -> DataFrame:
    return sets.select(F.size("items").alias("size"), F.array_join("items", " ").alias("items"), "n")


@_query(f"WITH {_SMALL} SELECT u AS basket, string_agg(i, ' ' ORDER BY i) AS items, count(*) AS n FROM b GROUP BY 1")
def baskets(spark: SparkSession, d: str) -> DataFrame:
    return I.basket_arrays(I.baskets(table(spark, d, "small1"), "user_id", "business_id")).select("basket", F.array_join("items", " ").alias("items"), F.size("items").alias("n"))


@_query(f"WITH {_SMALL} SELECT count(*) AS n_baskets, max(n) AS largest, sum(n) AS n_items FROM (SELECT u, count(*) AS n FROM b GROUP BY 1)")
def basket_sizes(spark: SparkSession, d: str) -> DataFrame:
    a = I.baskets(table(spark, d, "small1"), "user_id", "business_id").groupBy("basket").agg(F.count("*").alias("n"))
    return a.agg(F.count("*").alias("n_baskets"), F.max("n").alias("largest"), F.sum("n").alias("n_items"))


@_query(f"WITH {_SMALL} SELECT i AS basket, string_agg(u, ' ' ORDER BY u) AS items, count(*) AS n FROM b GROUP BY 1")
def baskets_of_users(spark: SparkSession, d: str) -> DataFrame:
    return I.basket_arrays(I.baskets(table(spark, d, "small1"), "business_id", "user_id")).select("basket", F.array_join("items", " ").alias("items"), F.size("items").alias("n"))


_RETAIL = "r AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey AS basket, CAST(l_partkey AS VARCHAR) AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@_query(f"WITH {_RETAIL} SELECT basket, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 5")
def basket_filter(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    r = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string")).alias("b"), F.col("l_partkey").cast("string").alias("i"))
    return I.baskets(r, "b", "i", more_than=5).groupBy("basket").agg(F.count("*").alias("n"))


@_query(f"WITH {_SMALL} SELECT 1 AS size, i AS items, count(*) AS n FROM b GROUP BY i HAVING count(*) >= {SUPPORT}")
def frequent_singletons(spark: SparkSession, d: str) -> DataFrame:
    return _shown(I.frequent_singletons(_rows(spark, d), SUPPORT))


@_query(f"WITH {_SMALL} SELECT 2 AS size, x.i || ' ' || y.i AS items, count(*) AS n FROM b x JOIN b y ON x.u = y.u AND x.i < y.i GROUP BY x.i, y.i HAVING count(*) >= {SUPPORT}")
def frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _shown(I.frequent_itemsets(_rows(spark, d), SUPPORT, max_size=2)).where("size = 2")


@_query(f"WITH {_SMALL} SELECT 3 AS size, x.i || ' ' || y.i || ' ' || z.i AS items, count(*) AS n FROM b x JOIN b y ON x.u = y.u AND x.i < y.i JOIN b z ON z.u = y.u AND y.i < z.i GROUP BY x.i, y.i, z.i HAVING count(*) >= {SUPPORT}")
def frequent_triples(spark: SparkSession, d: str) -> DataFrame:
    return _shown(I.frequent_itemsets(_rows(spark, d), SUPPORT, max_size=3)).where("size = 3")


@_query(f"WITH RECURSIVE {_SMALL}, {_LEVELS} SELECT size, items, n FROM fs")
def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    """Frequent sets of every size."""
    return _shown(I.frequent_itemsets(_rows(spark, d), SUPPORT))


@_query(f"WITH RECURSIVE {_SMALL}, {_LEVELS} SELECT size, items, n FROM fs")
def frequent_by_growth(spark: SparkSession, d: str) -> DataFrame:
    """The same by parallel pattern growth."""
    return _shown(I.frequent_by_growth(_rows(spark, d), SUPPORT))


_CHUNKS = f"""c AS (SELECT CAST(u AS BIGINT) % 4 AS c, u, i FROM b), m AS (SELECT c, count(DISTINCT u) AS m FROM c GROUP BY 1),
    w AS (SELECT c, (m * {SUPPORT} + (SELECT sum(m) FROM m) - 1) // (SELECT sum(m) FROM m) AS need FROM m),
    cf AS (SELECT c, i, any_value(need) AS need FROM c JOIN w USING (c) GROUP BY 1, 2 HAVING count(*) >= any_value(need)), cb AS (SELECT c, u, i, need FROM c JOIN cf USING (c, i)),
    co AS (SELECT 1 AS size, c, u, i AS items, i AS last FROM cb UNION ALL SELECT size + 1, co.c, co.u, items || ' ' || cb.i, cb.i FROM co JOIN cb ON cb.u = co.u AND cb.c = co.c AND cb.i > last
    QUALIFY count(*) OVER (PARTITION BY co.c, items || ' ' || cb.i) >= need), f AS (SELECT DISTINCT size, items FROM co)"""


def _chunked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, d)
    return rows, I.local_candidates(rows, SUPPORT, F.pmod(F.col("basket").cast("bigint"), F.lit(4)), None)


@_query(f"WITH RECURSIVE {_SMALL}, {_CHUNKS} SELECT size, items FROM f")
def son_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Sets of every size that are frequent in some chunk."""
    return _chunked(spark, d)[1].select(F.size("items").alias("size"), F.array_join("items", " ").alias("items"))


@_query(f"WITH RECURSIVE {_SMALL}, {_LEVELS} SELECT size, items, n FROM fs")
def son_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Frequent sets of every size, by the two passes over chunks."""
    rows, cand = _chunked(spark, d)
    return _shown(I.count_candidates(rows, cand, SUPPORT))


# ---- similar sets -----------------------------------------------------------------------------------------------

_SETS = f"a AS (SELECT DISTINCT {_key('business_id')} AS r, {_key('user_id')} AS m FROM yelp_train), s AS (SELECT r, m FROM a WHERE r IS NOT NULL AND m IS NOT NULL)"
_HASHES = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(hash_family(50, S.PRIME)))
_SIGNED = f"""x AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i FROM (SELECT DISTINCT m FROM {{src}})), h(k, a, b) AS (VALUES {_HASHES}),
    g AS (SELECT r, k, min(((CAST(a AS BIGINT) * i + b) % {S.PRIME}) % ((SELECT count(*) FROM x) + 1)) AS v FROM {{src}} JOIN x USING (m), h GROUP BY 1, 2)"""
_REPS = """q AS (SELECT r, string_agg(m, ' ' ORDER BY m) AS ms, count(*) AS n FROM s GROUP BY 1), e AS (SELECT min(r) AS r, any_value(n) AS n FROM q GROUP BY ms), o AS (SELECT s.r, s.m FROM s JOIN e USING (r))"""


@_query(f"WITH {_SETS}, {_SIGNED.format(src='s')} SELECT r AS record, string_agg(v, ' ' ORDER BY k) AS signature FROM g GROUP BY 1")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = written(S.set_rows(table(spark, d, "yelp_train"), "business_id", "user_id"), "set-rows")
    return S.minhash_signatures(rows).select("record", F.array_join(F.transform("signature", lambda x: x.cast("string")), " ").alias("signature"))


@_query(f"WITH {_SETS}, {_REPS} SELECT q.r AS record, (SELECT min(z.r) FROM q z WHERE z.ms = q.ms) AS rep, q.n AS size FROM q")
def set_classes(spark: SparkSession, d: str) -> DataFrame:
    return S.set_classes(S.set_rows(table(spark, d, "yelp_train"), "business_id", "user_id"))


_BANDED = "z AS (SELECT r, k // 2 AS band, string_agg(v, ',' ORDER BY k) AS sig FROM g GROUP BY 1, 2), p AS (SELECT DISTINCT x.r AS a, y.r AS b FROM z x JOIN z y ON x.band = y.band AND x.sig = y.sig AND x.r < y.r)"


@_query(f"WITH {_SETS}, {_REPS}, {_SIGNED.format(src='o')}, {_BANDED} SELECT a, b FROM p")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = written(S.set_rows(table(spark, d, "yelp_train"), "business_id", "user_id"), "set-rows")
    own = rows.join(S.set_classes(rows).where("record = rep").select("record"), "record", "left_semi")
    return S.lsh_candidates(S.minhash_signatures(written(own, "rep-rows")))


@_query(
    f"""WITH {_SETS}, {_REPS}, {_SIGNED.format(src='o')}, {_BANDED}, j AS (SELECT a, b, count(*) AS i FROM p JOIN o x ON x.r = a JOIN o y ON y.r = b AND y.m = x.m GROUP BY 1, 2)
    SELECT a, b, round(CAST(i AS DOUBLE) / (ea.n + eb.n - i), 6) AS similarity FROM j JOIN e ea ON ea.r = a JOIN e eb ON eb.r = b WHERE 2 * i >= ea.n + eb.n - i"""
)
def lsh_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.lsh_similar(table(spark, d, "yelp_train"), "business_id", "user_id", 0.5)


# ---- rating prediction ------------------------------------------------------------------------------------------

SPLIT = "2014-08-01"  # ratings before it train, later ones test

_RATED = f"""k AS (SELECT {_key('user_id')} AS u, {_key('business_id')} AS i, stars, row_no, rated_at >= TIMESTAMP '{SPLIT}' AS late FROM yelp_train WHERE stars IS NOT NULL AND rated_at IS NOT NULL),
    r AS (SELECT u, i, arg_max(stars, row_no) AS s FROM k WHERE u IS NOT NULL AND i IS NOT NULL AND NOT late GROUP BY 1, 2),
    e AS (SELECT u, i, arg_max(stars, row_no) AS s FROM k WHERE u IS NOT NULL AND i IS NOT NULL AND late GROUP BY 1, 2),
    im AS (SELECT i, avg(s) AS m, count(*) AS n FROM r GROUP BY 1), um AS (SELECT u, avg(s) AS m, count(*) AS n FROM r GROUP BY 1),
    dv AS (SELECT r.u, r.i, r.s, r.s - im.m AS d FROM r JOIN im USING (i))"""
_SIM = """si AS (SELECT i, j, CASE WHEN den > 1e-12 THEN round(num / den, 9) + 0.0 ELSE 0.0 END AS sim, c AS raters FROM (SELECT a.i AS i, b.i AS j, sum(a.d * b.d) AS num,
    sqrt(sum(a.d * a.d)) * sqrt(sum(b.d * b.d)) AS den, count(*) AS c FROM dv a JOIN dv b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2))"""
_NEAR = """nb AS (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY sim DESC, o) AS k FROM (SELECT e.u, e.i, r.i AS o, r.s, si.sim FROM e JOIN r ON r.u = e.u AND r.i <> e.i
    JOIN si ON si.i = least(e.i, r.i) AND si.j = greatest(e.i, r.i)) QUALIFY k <= 20)"""
_PRED = """pr AS (SELECT e.u, e.i, e.s, round(CASE WHEN um.m IS NULL AND im.m IS NULL THEN (SELECT avg(s) FROM r) WHEN im.m IS NULL THEN um.m WHEN um.m IS NULL THEN im.m
    WHEN um.n = 1 AND own.s IS NOT NULL THEN own.s WHEN coalesce(den, 0) = 0 THEN (im.m + um.m) / 2
    ELSE greatest(0.0, least(5.0, 0.1 * num / den + 0.5 * im.m + 0.4 * um.m)) END, 6) AS p
    FROM e LEFT JOIN um USING (u) LEFT JOIN im USING (i) LEFT JOIN r own ON own.u = e.u AND own.i = e.i
    LEFT JOIN (SELECT u, i, sum(s * sim) AS num, sum(abs(sim)) AS den FROM nb GROUP BY 1, 2) q ON q.u = e.u AND q.i = e.i)"""


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "yelp_train").where("rated_at is not null")
    late = F.col("rated_at") >= F.lit(SPLIT).cast("timestamp")
    return tuple(written(R.ratings(t.where(x), "user_id", "business_id", "stars", "row_no"), "ratings") for x in (~late, late))


@_query(f"WITH {_RATED}, {_SIM} SELECT i, j, sim, raters FROM si")
def item_similarity(spark: SparkSession, d: str) -> DataFrame:
    return R.item_similarity(_split(spark, d)[0])


@_query(f"WITH {_RATED}, {_SIM}, {_NEAR} SELECT u AS user, i AS item, o AS other, s AS stars, sim, k AS rank FROM nb")
def top_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbours(*_split(spark, d))


@_query(f"WITH {_RATED}, {_SIM}, {_NEAR}, {_PRED} SELECT u AS user, i AS item, p AS prediction FROM pr")
def item_cf_predictions(spark: SparkSession, d: str) -> DataFrame:
    return R.item_cf(*_split(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return R.item_cf(train, test).join(test, ["user", "item"])


@_query(f"WITH {_RATED}, {_SIM}, {_NEAR}, {_PRED} SELECT round(sqrt(avg((p - s) * (p - s))), 5) AS rmse, count(*) AS n FROM pr")
def cf_rmse(spark: SparkSession, d: str) -> DataFrame:
    return rel.rmse(_scored(spark, d), "prediction", "stars", 5)


@_query(f"WITH {_RATED}, {_SIM}, {_NEAR}, {_PRED} SELECT CAST(least(floor(abs(p - s)), 4) AS INTEGER) AS bin, count(*) AS n FROM pr GROUP BY 1")
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rel.error_histogram(_scored(spark, d), "prediction", "stars")


_COMPLIMENTS = " + ".join(f"coalesce(compliment_{c}, 0)" for c in ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos"))
_USERS = f"""uf AS (SELECT u, max_by(f, o) AS f FROM (SELECT {_key('user_id')} AS u, arrival_no AS o, struct_pack(a := CAST(review_count AS DOUBLE), b := CAST(fans AS DOUBLE), c := average_stars,
    d := CAST(CASE WHEN friends IS NULL THEN 0 ELSE len(string_split(friends, ',')) END AS DOUBLE), e := CAST(coalesce(useful, 0) + coalesce(funny, 0) + coalesce(cool, 0) AS DOUBLE),
    f := CAST(2023 - TRY_CAST(substr(yelping_since, 1, 4) AS INTEGER) AS DOUBLE), g := CAST(CASE WHEN elite IS NULL THEN 0 ELSE len(string_split(elite, ',')) END AS DOUBLE), h := CAST({_COMPLIMENTS} AS DOUBLE)) AS f
    FROM yelp_user) WHERE u IS NOT NULL GROUP BY 1), uv AS (SELECT u, var_pop(s) AS v FROM r GROUP BY 1), ul AS (SELECT {_key('user_id')} AS u, CAST(count(*) AS DOUBLE) AS k FROM yelp_train GROUP BY 1),
    ux AS (SELECT uf.u, f.a, f.b, f.c, f.d, f.e, f.f, f.g, f.h, coalesce(v, 0.0) AS v, coalesce(k, 0.0) AS k FROM uf LEFT JOIN uv USING (u) LEFT JOIN ul USING (u))"""


@_query(
    f"""WITH {_RATED}, {_USERS} SELECT u AS user, a AS user_reviews, b AS fans, c AS user_stars, d AS friends, e AS social, f AS years, g AS elite, h AS compliments, round(v + 1e-9, 6) AS user_var, k AS user_likes FROM ux"""
)
def user_features(spark: SparkSession, d: str) -> DataFrame:
    return _user_side(spark, d, _split(spark, d)[0]).withColumn("user_var", F.round(F.col("user_var") + 1e-9, 6))


_SCORE = " + ".join(f"CASE WHEN f.m['{k}'] IS NOT NULL AND f.m['{k}'] <> 'False' THEN 1 ELSE 0 END" for k in SCORED_ATTRIBUTES)
_ITEMS = f"""bf AS (SELECT i, arg_max(f, o) AS f FROM (SELECT {_key('business_id')} AS i, coalesce(listed_at, TIMESTAMP '1900-01-01') AS o, struct_pack(s := stars, n := review_count, m := attributes) AS f FROM business) WHERE i IS NOT NULL GROUP BY 1),
    bv AS (SELECT i, var_pop(s) AS v FROM r GROUP BY 1), tp AS (SELECT {_key('business_id')} AS i, count(*) AS n, count(*) FILTER (source IS DISTINCT FROM 'menu') AS p FROM documents GROUP BY 1),
    sl AS (SELECT {_key('business_id')} AS i, count(DISTINCT strftime(rated_at, '%w-%H')) AS n FROM yelp_train GROUP BY 1),
    bx AS (SELECT bf.i AS i, f.s AS a, CAST(f.n AS DOUBLE) AS b, coalesce(TRY_CAST(f.m['RestaurantsPriceRange2'] AS DOUBLE), 0.0) AS c, CAST({_SCORE} AS DOUBLE) AS d, coalesce(v, 0.0) AS e,
    coalesce(CAST(tp.p AS DOUBLE), 0.0) AS f, coalesce(CAST(sl.n AS DOUBLE), 0.0) AS g, coalesce(CAST(tp.n AS DOUBLE), 0.0) AS h FROM bf LEFT JOIN bv USING (i) LEFT JOIN tp USING (i) LEFT JOIN sl USING (i))"""


def _user_side(spark: SparkSession, d: str, train: DataFrame) -> DataFrame:
    """User features; each delivery of a rating counts as a tip liked once."""
    return R.user_features(table(spark, d, "yelp_user"), "arrival_no", train, table(spark, d, "yelp_train").select("user_id", F.lit(1).alias("likes")))


def _item_side(spark: SparkSession, d: str, train: DataFrame) -> DataFrame:
    """Business features: texts count as tips and, by source, as photos; the hours of the week in which ratings came as check-in slots."""
    docs, t = table(spark, d, "documents"), table(spark, d, "yelp_train")
    hours = t.where("rated_at is not null").select("business_id", F.concat_ws("-", F.dayofweek("rated_at"), F.hour("rated_at")).alias("hour"))
    checkins = hours.groupBy(clean_key("business_id").alias("business_id")).agg(F.collect_set("hour").alias("time"))  # at most 168
    return R.business_features(table(spark, d, "business"), "listed_at", train, docs.select("business_id", F.col("source").alias("label")), checkins, docs.select("business_id", F.lit(1).alias("likes")))


@_query(f"WITH {_RATED}, {_ITEMS} SELECT i AS item, a AS item_stars, b AS item_reviews, c AS price, d AS score, round(e + 1e-9, 6) AS item_var, f AS photos, g AS slots, h AS item_likes FROM bx")
def business_features(spark: SparkSession, d: str) -> DataFrame:
    return _item_side(spark, d, _split(spark, d)[0]).withColumn("item_var", F.round(F.col("item_var") + 1e-9, 6))


@_query(
    f"""WITH {_RATED}, {_USERS}, {_ITEMS}, mu AS (SELECT avg(a) a, avg(b) b, avg(c) c, avg(d) d, avg(e) e FROM ux), mi AS (SELECT avg(a) a, avg(b) b, avg(c) c FROM bx)
    SELECT e.u AS user, e.i AS item, e.s AS stars, round(coalesce(x.a, mu.a, 0), 5) AS user_reviews, round(coalesce(x.b, mu.b, 0), 5) AS fans, round(coalesce(x.c, mu.c, 0), 5) AS user_stars,
    round(coalesce(x.d, mu.d, 0), 5) AS friends, round(coalesce(x.e, mu.e, 0), 5) AS social, coalesce(x.f, 0.0) AS years, coalesce(x.g, 0.0) AS elite, coalesce(x.h, 0.0) AS compliments,
    round(coalesce(x.v, 0.0) + 1e-9, 5) AS user_var, coalesce(x.k, 0.0) AS user_likes, round(coalesce(y.a, mi.a, 0), 5) AS item_stars, round(coalesce(y.b, mi.b, 0), 5) AS item_reviews, round(coalesce(y.c, mi.c, 0), 5) AS price,
    coalesce(y.d, 0.0) AS score, round(coalesce(y.e, 0.0) + 1e-9, 5) AS item_var, coalesce(y.f, 0.0) AS photos, coalesce(y.g, 0.0) AS slots, coalesce(y.h, 0.0) AS item_likes
    FROM e LEFT JOIN ux x ON x.u = e.u LEFT JOIN bx y ON y.i = e.i, mu, mi"""
)
def feature_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Test ratings with the features of their users and items and cold-start defaults."""
    train, test = _split(spark, d)
    out = R.assemble(test, _user_side(spark, d, train), _item_side(spark, d, train))
    out = out.withColumns({c: F.col(c) + 1e-9 for c in ("user_var", "item_var")})  # off the rounding ties of small groups, as in the SQL
    return out.select(*[F.round(c, 5).alias(c) if c in (*R.MEAN_DEFAULTS, "user_var", "item_var") else c for c in out.columns])


def _trees(spark: SparkSession, d: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """Predictions for the later ratings of 200 trees of depth 7 on 0.4 of the columns each, fitted on every earlier rating."""
    u, b = written(_user_side(spark, d, train), "user-features"), written(_item_side(spark, d, train), "business-features")
    a = R.assemble(train, u, b)
    f = [c for c in a.columns if c not in (*R.NOT_FEATURES, "item_var", "user_var")]  # the spreads hold the label
    return written(B.predict(B.fit(a, f, n=train.count()), R.assemble(test, u, b), f), "tree-predictions")


@_query()
def gbt_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, *_split(spark, d))


@_query()
def hybrid_blend(spark: SparkSession, d: str) -> DataFrame:
    split = _split(spark, d)
    return R.blend(_trees(spark, d, *split), R.item_cf(*split))


@_query()
def blend_search(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return R.search_blend(_trees(spark, d, train, test), R.item_cf(train, test), test)


@_query()
def model_errors(spark: SparkSession, d: str) -> DataFrame:
    """Root mean squared error on the later ratings: of the mean of the earlier ones, the item neighbourhoods, the trees and their blend."""
    train, test = _split(spark, d)
    m = _trees(spark, d, train, test)
    items = written(R.item_cf(train, test), "item-predictions")
    flat = test.select("user", "item").join(F.broadcast(train.agg(F.avg("stars").alias("prediction"))))  # one row
    out = None
    for name, p in (("mean", flat), ("items", items), ("trees", m), ("blend", R.blend(m, items))):
        e = rel.rmse(p.join(test, ["user", "item"]), "prediction", "stars").select(F.lit(name).alias("model"), "rmse", "n")
        out = e if out is None else out.unionByName(e)
    return out


# ---- graphs -----------------------------------------------------------------------------------------------------

#: One graph for all graph queries: businesses that at least so many users have in common. It doesn't thin out as data grow.
COMMON = 12
_GRAPH = f"{_SMALL}, ed AS (SELECT x.i AS u, y.i AS v, count(*) AS common FROM b x JOIN b y ON x.u = y.u AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= {COMMON})"
_SYM = "sy AS (SELECT u AS s, v AS t FROM ed UNION ALL SELECT v, u FROM ed)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return written(G.cooccurrence_edges(_rows(spark, d), "item", "basket", COMMON), "edges")


@_query(f"WITH {_GRAPH} SELECT u, v, common FROM ed")
def cooccurrence_graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def _lpa(rounds: int) -> str:
    out = "l0 AS (SELECT DISTINCT s AS id, s AS label FROM sy)"
    for k in range(1, rounds + 1):
        out += f", l{k} AS (SELECT id, label FROM (SELECT t AS id, label, count(*) AS n FROM sy JOIN l{k - 1} ON l{k - 1}.id = s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"
    return out


@_query(f"WITH {_GRAPH}, {_SYM}, {_lpa(5)} SELECT id, label FROM l5")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(_edges(spark, d))


@_query(f"WITH {_GRAPH}, {_SYM}, {_lpa(5)} SELECT string_agg(id, ' ' ORDER BY id) AS members, count(*) AS size FROM l5 GROUP BY label")
def communities(spark: SparkSession, d: str) -> DataFrame:
    c = G.communities(G.label_propagation(_edges(spark, d)))
    return c.select(F.array_join("members", " ").alias("members"), "size")


@_query(f"WITH RECURSIVE {_GRAPH}, {_SYM}, w AS (SELECT DISTINCT s AS id, s AS c FROM sy UNION SELECT t, c FROM w JOIN sy ON w.id = sy.s) SELECT id, min(c) AS component FROM w GROUP BY 1")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(_edges(spark, d))


@_query(
    f"""WITH {_GRAPH}, {_SYM}, {_lpa(5)}, m AS (SELECT 2.0 * count(*) AS m FROM ed), dg AS (SELECT s AS id, count(*) AS k FROM sy GROUP BY 1), a AS (SELECT label, sum(k) AS d FROM l5 JOIN dg USING (id) GROUP BY 1),
    n AS (SELECT x.label, count(*) AS i FROM ed JOIN l5 x ON x.id = u JOIN l5 y ON y.id = v AND y.label = x.label GROUP BY 1)
    SELECT a.label, round((2 * coalesce(i, 0) - d * d / m) / m, 9) AS share FROM a LEFT JOIN n USING (label), m"""
)
def modularity(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return G.modularity(e, G.label_propagation(e))


# distances as the least length of a walk (walks of one length are kept once), then shortest paths counted level by level
_PATHS = """wk AS (SELECT DISTINCT s AS r, s AS n, 0 AS d FROM sy UNION SELECT r, t, d + 1 FROM wk JOIN sy ON s = n WHERE d < 40), ds AS (SELECT r, n, min(d) AS d FROM wk GROUP BY 1, 2),
    sg AS (SELECT r, n, d, 1.0::DOUBLE AS p FROM ds WHERE d = 0 UNION ALL SELECT sg.r, ds.n, ds.d, sum(sg.p) FROM sg JOIN sy ON s = sg.n JOIN ds ON ds.r = sg.r AND ds.n = t AND ds.d = sg.d + 1 GROUP BY 1, 2, 3)"""


@_query(
    f"""WITH RECURSIVE {_GRAPH}, {_SYM}, {_PATHS} SELECT least(s, t) AS u, greatest(s, t) AS v, round(sum(x.p * y.p / z.p) / 2, 4) AS betweenness
    FROM sy JOIN sg x ON x.n = s JOIN sg y ON y.n = t JOIN sg z ON z.r = x.r AND z.n = y.r AND z.d = x.d + 1 + y.d GROUP BY 1, 2"""
)
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_betweenness(_edges(spark, d)).withColumn("betweenness", F.round("betweenness", 4))


@_query()
def girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    return G.girvan_newman(_edges(spark, d))


# ---- streams ----------------------------------------------------------------------------------------------------

_STREAM = "st AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events), sb AS (SELECT *, (seq - 1) // 300 AS batch FROM st)"
_FAMILY = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(hash_family(10, K.PRIME)))
_FOLD = f"list_reduce(list_transform(string_split(CAST(key AS VARCHAR), ''), lambda q: CAST(ascii(q) AS BIGINT)), lambda a, q: (a * 256 + q) % {K.PRIME}, CAST(0 AS BIGINT))"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return K.batches(table(spark, d, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], 300)


@_query(f"WITH {_STREAM} SELECT event_id, seq, batch FROM sb")
def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d).select("event_id", "seq", "batch")


@_query(
    f"""WITH {_STREAM}, rw AS (SELECT batch, user_id AS key, count(*) AS n FROM sb WHERE user_id IS NOT NULL GROUP BY 1, 2), fi AS (SELECT key, min(batch) AS f FROM rw GROUP BY 1), h(k, a, b) AS (VALUES {_FAMILY}),
    ma AS (SELECT key, f, ((CAST(a AS BIGINT) * {_FOLD} + b) % {K.PRIME}) % {K.BITS} AS bit FROM fi, h), bt AS (SELECT bit, min(f) AS t FROM ma GROUP BY 1), re AS (SELECT key, any_value(f) AS f, max(t) AS ready FROM ma JOIN bt USING (bit) GROUP BY 1),
    su AS (SELECT batch, sum(CASE WHEN f = batch AND ready < batch THEN n ELSE 0 END) AS fp, sum(CASE WHEN ready >= batch THEN n ELSE 0 END) AS negatives FROM rw JOIN re USING (key) GROUP BY 1)
    SELECT batch, fp, negatives, round(CASE WHEN fp + negatives > 0 THEN fp / (fp + negatives) ELSE 0.0 END, 9) AS fpr FROM su"""
)
def bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    return K.bloom_fpr(_stream(spark, d), "user_id")


@_query(
    f"""WITH {_STREAM}, k AS (SELECT DISTINCT batch, user_id AS key FROM sb WHERE user_id IS NOT NULL), h(k, a, b) AS (VALUES {_FAMILY}),
    z AS (SELECT batch, h.k, key, ((CAST(a AS BIGINT) * {_FOLD} + b) % {K.PRIME}) % {K.BITS} AS v FROM k, h), m AS (SELECT batch, k, max(CASE WHEN v = 0 THEN 3 ELSE length(bin(v)) - length(rtrim(bin(v), '0')) END) AS r FROM z GROUP BY 1, 2)
    SELECT m.batch, n.truth, CAST(round_even(avg(power(2.0, r)), 0) AS BIGINT) AS estimate FROM m JOIN (SELECT batch, count(*) AS truth FROM k GROUP BY 1) n ON n.batch = m.batch GROUP BY 1, 2"""
)
def fm_estimate(spark: SparkSession, d: str) -> DataFrame:
    return K.fm_estimates(_stream(spark, d), "user_id")


def _digest(tag: str) -> str:
    return f"CAST('0x' || substr(md5('{tag}:' || seq), 1, 12) AS BIGINT)"


@_query(
    "WITH n AS (SELECT user_id AS value, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM events)), q AS (SELECT unnest(range(1, 9001)) AS seq)"
    " SELECT (seq - 1) // 300 AS batch, seq, value FROM q JOIN n ON idx = CAST('0x' || substr(md5('d1:' || seq), 1, 12) AS BIGINT) % (SELECT count(*) FROM n)"
)
def simulated_stream(spark: SparkSession, d: str) -> DataFrame:
    return K.drawn_with_replacement(table(spark, d, "events").select("user_id").distinct(), "user_id", 300, 30)


_SHOWN = (0, 20, 40, 60, 80)


@_query(
    f"""WITH {_STREAM}, tk AS (SELECT batch, seq, user_id, CASE WHEN seq <= 100 THEN seq - 1 WHEN CAST({_digest('r1a')} AS HUGEINT) * seq < CAST(100 AS HUGEINT) * {1 << 48} THEN {_digest('r1b')} % 100 END AS slot FROM sb),
    en AS (SELECT batch, max(seq) AS seq FROM sb GROUP BY 1) SELECT batch, seq, {", ".join(f"(SELECT arg_max(user_id, tk.seq) FROM tk WHERE slot = {k} AND tk.seq <= en.seq) AS slot_{k}" for k in _SHOWN)} FROM en"""
)
def reservoir_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return K.reservoir_snapshots(_stream(spark, d), "user_id", 100, _SHOWN)


@_query("SELECT event_id, user_id FROM events ORDER BY md5('b1:' || event_id), event_id LIMIT 100")
def bottom_k_sample(spark: SparkSession, d: str) -> DataFrame:
    return K.bottom_k(table(spark, d, "events").select("event_id", "user_id"), "event_id", 100)


# ---- clustering -------------------------------------------------------------------------------------------------


@_query("SELECT vec_id, CAST(((769 * vec_id + 421) % 2023) % 5 AS INTEGER) AS bucket FROM embeddings")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return C.hash_split(table(spark, d, "embeddings").select("vec_id"), "vec_id")


_DIMS = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@_query(f"WITH {_DIMS} SELECT label, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(sum(x), 4) + 0.0 AS s, round(sum(x * x), 4) AS ss FROM x GROUP BY 1, 2")
def cluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = C.cluster_summaries(table(spark, d, "embeddings"), "label", "embedding")
    return s.withColumn("s", F.col("s") + F.lit(0.0))


@_query(
    f"""WITH {_DIMS}, c AS (SELECT label, dim, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS v FROM x GROUP BY 1, 2),
    dd AS (SELECT vec_id, c.label, sqrt(sum((x.x - m) * (x.x - m) / v)) AS dist FROM x JOIN c USING (dim) GROUP BY 1, 2),
    b AS (SELECT vec_id, label, dist FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) = 1)
    SELECT vec_id, CAST(CASE WHEN dist <= 16 THEN label ELSE -1 END AS BIGINT) AS cluster, round(dist, 4) AS distance FROM b"""
)
def mahalanobis_assign(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    s = C.summaries_of(e.select("label", F.col("embedding").alias("features")))
    return C.nearest_cluster(e, "vec_id", "embedding", sorted(s.items())).select(F.col("index").alias("vec_id"), "cluster", F.round("distance", 4).alias("distance"))


@_query()
def bfr_round_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.bfr(table(spark, d, "embeddings"), "vec_id", "embedding", 8).stats(spark)


@_query()
def bfr_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.bfr(table(spark, d, "embeddings"), "vec_id", "embedding", 8).labels()
