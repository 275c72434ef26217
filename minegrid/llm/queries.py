"""Queries of the problems on data for language models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import table, trimmed, written
from .chunk_encode import encode_corpus
from .distinct_runs import ALL, build_runs, count_ranges, counts_by, with_bound
from .ledger import judge_in_batches
from .pair_table import pair_table
from .packing import pack
from .sampling import uniform_sample
from .set_join import similar_classes, similar_pairs
from .stuffing import stuffed_pages

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = pair_table(table(spark, d, "small1"), "user_id", "business_id")
    s = t.scores(min_together=12)
    n = t.n_baskets()
    return s.where(F.col("m") * F.lit(n) >= 4 * F.col("n1") * F.col("n2")).select(F.col("item_1").alias("business_id_1"), F.col("item_2").alias("business_id_2"))


def _shown(s: DataFrame) -> DataFrame:
    return s.select(F.col("item_1").alias("business_id_1"), F.col("item_2").alias("business_id_2"), "m", "n1", "n2", F.round("lift", 6).alias("lift"))


def p1_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs together, once or more."""
    return _shown(pair_table(table(spark, d, "small1"), "user_id", "business_id").scores())


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of ``p1_all_pairs`` that occur together at least twice, as its SQL has it."""
    s = pair_table(table(spark, d, "small1"), "user_id", "business_id").scores(min_together=2)
    return _shown(s)


_P1 = f"""
WITH s AS (SELECT DISTINCT trim(user_id, {_BLANK}) u, trim(business_id, {_BLANK}) b FROM small1 WHERE trim(user_id, {_BLANK}) <> '' AND trim(business_id, {_BLANK}) <> ''),
n AS (SELECT b, count(*) n FROM s GROUP BY 1), t AS (SELECT count(DISTINCT u) nn FROM s),
p AS (SELECT x.b AS b1, y.b AS b2, count(*) AS m FROM s x JOIN s y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2),
q AS (SELECT b1, b2, m, n1.n AS n1, n2.n AS n2, nn FROM p JOIN n n1 ON n1.b = b1 JOIN n n2 ON n2.b = b2, t)
"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return written(build_runs(table(spark, d, "yelp_user"), "user_id", "arrived_at", ["client_app", "home_city"]), "runs")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = similar_pairs(table(spark, d, "yelp_train"), "business_id", "user_id", 1, 2, least=5)
    return p.select(F.col("id_1").alias("business_id_1"), F.col("id_2").alias("business_id_2"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Per business with at least 5 users: how many other businesses its user set is similar to (copies included)."""
    members, pairs = similar_classes(table(spark, d, "yelp_train"), "business_id", "user_id", 1, 2, least=5)
    size = members.groupBy("c").agg(F.count("*").alias("k"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(size.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("k").alias("links"))
    return members.join(size, "c").join(links, "c", "left").select(F.col("id").alias("business_id"), F.col("n").alias("n_users"), (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"))


_P3 = f"""
WITH s AS (SELECT DISTINCT trim(user_id, {_BLANK}) u, trim(business_id, {_BLANK}) b FROM yelp_train WHERE trim(user_id, {_BLANK}) <> '' AND trim(business_id, {_BLANK}) <> ''),
n AS (SELECT b, count(*) n FROM s GROUP BY 1 HAVING count(*) >= 5), t AS (SELECT s.b, s.u, n.n FROM s JOIN n USING (b)),
p AS (SELECT x.b AS b1, y.b AS b2, any_value(x.n) AS n1, any_value(y.n) AS n2, count(*) AS m FROM t x JOIN t y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2),
f AS (SELECT b1, b2 FROM p WHERE 2 * m >= n1 + n2 - m)
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "task2").where("estimation is not null")
    asked = lines.select(
        "time_no", "estimation", F.to_date(trimmed("day_from")).alias("day_from"), F.to_date(trimmed("day_to")).alias("day_to"),
        F.coalesce("client_app", F.lit(ALL)).alias("client_app"), F.coalesce("home_city", F.lit(ALL)).alias("home_city"),
    )
    exact = count_ranges(_runs(spark, d), asked, ["client_app", "home_city"])
    both = asked.join(exact, ["day_from", "day_to", "client_app", "home_city"])
    return both.where(5 * F.abs(F.col("estimation") - F.col("n")) > F.col("n")).select("time_no")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users per day, app and city, for every combination (null: all of them), with the error bound rounded up."""
    c = counts_by(_runs(spark, d), ["day", "client_app", "home_city"])
    return c.select(F.col("day").cast("string").alias("day"), *[F.when(F.col(x) != ALL, F.col(x)).alias(x) for x in ("client_app", "home_city")], "n", (F.col("max_error") < 1e-6).alias("exact_to_a_millionth"))


def p4_all_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users per app, city and both (null: all of them) of each day, over all days and over every run of days that task2 names, with the error bound."""
    dims = ["client_app", "home_city"]
    runs = _runs(spark, d)
    days = counts_by(runs, ["day", *dims]).select(F.lit("day").alias("kind"), F.col("day").alias("day_from"), F.col("day").alias("day_to"), *dims, "n", "max_error")
    none = F.lit(None).cast("date")
    whole = counts_by(runs, dims).select(F.lit("all").alias("kind"), none.alias("day_from"), none.alias("day_to"), *dims, "n", "max_error")
    named = table(spark, d, "task2").select(F.to_date(trimmed("day_from")).alias("day_from"), F.to_date(trimmed("day_to")).alias("day_to")).where("day_from is not null and day_to is not null").distinct()
    asked = written(named.crossJoin(runs.select(*dims).distinct()), "asked-runs")
    ranges = with_bound(count_ranges(runs, asked, dims).where("n > 0")).select(F.lit("run").alias("kind"), "day_from", "day_to", *dims, "n", "max_error")
    c = days.unionByName(whole).unionByName(ranges)
    return c.select("kind", *[F.col(x).cast("string").alias(x) for x in ("day_from", "day_to")], *[F.when(F.col(x) != ALL, F.col(x)).alias(x) for x in dims], "n", "max_error")


_P4 = f"""
WITH u AS (SELECT DISTINCT CAST(arrived_at AS DATE) AS day, client_app, home_city, trim(user_id, {_BLANK}) k FROM yelp_user WHERE trim(user_id, {_BLANK}) <> '' AND arrived_at IS NOT NULL)
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return judge_in_batches(table(spark, d, "yelp_user").select("arrival_no", "user_id"), "user_id", "arrival_no").where("seen").select("arrival_no")


def p5_error(spark: SparkSession, d: str) -> DataFrame:
    """Answers and how many are wrong, measured: a key's rows must hold exactly one unseen row, its first."""
    j = judge_in_batches(table(spark, d, "yelp_user").select("arrival_no", "user_id"), "user_id", "arrival_no")
    k = j.where("seen is not null").groupBy(trimmed("user_id").alias("k")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("seen"), 0).otherwise(1)).alias("unseen"),
        F.min("arrival_no").alias("first"), F.min(F.when(~F.col("seen"), F.col("arrival_no"))).alias("said"),
    )
    wrong = F.abs(F.col("unseen") - 1) + F.when(F.col("first").eqNullSafe(F.col("said")), 0).otherwise(1)
    return k.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"), F.coalesce(F.sum(F.col("n") - F.col("unseen")), F.lit(0)).alias("n_seen"), F.coalesce(F.sum(wrong), F.lit(0)).alias("n_wrong")).withColumn(
        "wrong_share", F.when(F.col("n_answers") > 0, F.col("n_wrong") / F.col("n_answers")).otherwise(0.0)
    )


_P5 = f"WITH k AS (SELECT arrival_no, trim(user_id, {_BLANK}) k FROM yelp_user WHERE trim(user_id, {_BLANK}) <> ''), s AS (SELECT *, min(arrival_no) OVER (PARTITION BY k) f FROM k)"


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return uniform_sample(table(spark, d, "yelp_user").select("arrival_no", "piece_no", "user_id"), 100, ["arrival_no"], "s1")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, against the least number that could hold all tokens."""
    boxes = p9_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    a = boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return a.withColumn("least_containers", F.ceil(F.col("tokens") / 2048)).withColumn("fill", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * 2048)))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(table(spark, d, "documents")).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """What the verdict on each case is made of: mean PMI of neighbours, share of repeated pairs, share of stuffed words, score."""
    return stuffed_pages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_all_pairs, p3_found, p3_links, p4_found, p4_counts, p4_all_counts, p5_found, p5_error, p7_sample, p8_ids, p9_containers, p9_fill, p10_found, p10_scores)}
ORACLES = {
    "p1_found": _P1 + "SELECT b1 AS business_id_1, b2 AS business_id_2 FROM q WHERE m >= 12 AND m * nn >= 4 * n1 * n2",
    "p1_pairs": _P1 + "SELECT b1 AS business_id_1, b2 AS business_id_2, m, n1, n2, round(CAST(m AS DOUBLE) * nn / (CAST(n1 AS DOUBLE) * n2), 6) AS lift FROM q WHERE m >= 2",
    "p1_all_pairs": _P1 + "SELECT b1 AS business_id_1, b2 AS business_id_2, m, n1, n2, round(CAST(m AS DOUBLE) * nn / (CAST(n1 AS DOUBLE) * n2), 6) AS lift FROM q",
    "p3_found": _P3 + "SELECT b1 AS business_id_1, b2 AS business_id_2 FROM f",
    "p3_links": _P3 + "SELECT n.b AS business_id, n.n AS n_users, count(o) AS n_links FROM n LEFT JOIN (SELECT b1 AS i, b2 AS o FROM f UNION ALL SELECT b2, b1 FROM f) ON i = n.b GROUP BY 1, 2",
    "p4_found": _P4 + """, e AS (SELECT time_no, any_value(estimation) AS e, count(DISTINCT k) AS n FROM task2 LEFT JOIN u ON day BETWEEN CAST(day_from AS DATE) AND CAST(day_to AS DATE)
        AND (task2.client_app IS NULL OR task2.client_app = u.client_app) AND (task2.home_city IS NULL OR task2.home_city = u.home_city) WHERE estimation IS NOT NULL GROUP BY 1)
        SELECT time_no FROM e WHERE abs(e - n) > 0.2 * n""",
    "p4_counts": _P4 + """SELECT CAST(day AS VARCHAR) AS day, client_app, home_city, n, true AS exact_to_a_millionth FROM (
        SELECT day, NULL AS client_app, NULL AS home_city, count(DISTINCT k) AS n FROM u GROUP BY 1
        UNION ALL SELECT day, client_app, NULL, count(DISTINCT k) FROM u WHERE client_app IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT day, NULL, home_city, count(DISTINCT k) FROM u WHERE home_city IS NOT NULL GROUP BY 1, 3
        UNION ALL SELECT day, client_app, home_city, count(DISTINCT k) FROM u WHERE client_app IS NOT NULL AND home_city IS NOT NULL GROUP BY 1, 2, 3)""",
    "p4_all_counts": _P4 + """, x AS (SELECT day, k, client_app, home_city FROM u WHERE client_app IS NOT NULL AND home_city IS NOT NULL UNION ALL SELECT day, k, client_app, NULL FROM u WHERE client_app IS NOT NULL
        UNION ALL SELECT day, k, NULL, home_city FROM u WHERE home_city IS NOT NULL UNION ALL SELECT day, k, NULL, NULL FROM u),
        r AS (SELECT DISTINCT CAST(day_from AS DATE) AS f, CAST(day_to AS DATE) AS t FROM task2 WHERE day_from IS NOT NULL AND day_to IS NOT NULL),
        c AS (SELECT 'day' AS kind, day AS f, day AS t, client_app, home_city, count(DISTINCT k) AS n FROM x GROUP BY day, client_app, home_city
        UNION ALL SELECT 'all', NULL, NULL, client_app, home_city, count(DISTINCT k) FROM x GROUP BY client_app, home_city
        UNION ALL SELECT 'run', f, t, client_app, home_city, count(DISTINCT k) FROM x JOIN r ON day BETWEEN f AND t GROUP BY f, t, client_app, home_city)
        SELECT kind, CAST(f AS VARCHAR) AS day_from, CAST(t AS VARCHAR) AS day_to, client_app, home_city, n, CAST(n AS DOUBLE) * (n - 1) / power(2.0, 65) AS max_error FROM c""",
    "p5_found": _P5 + "SELECT arrival_no FROM s WHERE arrival_no > f",
    "p5_error": _P5 + "SELECT count(*) AS n_answers, count(*) FILTER (arrival_no > f) AS n_seen, 0 AS n_wrong, 0.0::DOUBLE AS wrong_share FROM s",
    "p7_sample": "SELECT arrival_no, piece_no, user_id FROM yelp_user ORDER BY md5('s1:' || arrival_no) LIMIT 100",
}
