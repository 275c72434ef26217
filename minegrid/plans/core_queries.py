"""Queries of the two general data-quality problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import explode_packed, reading_report
from ..operators.references import Reference, orphan_report, orphans, run_report
from ..util import table


def _targets(spark: SparkSession, d: str) -> list[Reference]:
    return [
        Reference("user_id", table(spark, d, "yelp_user"), "user_id", "arrived_at", "deleted_at"),
        Reference("business_id", table(spark, d, "business"), "business_id", "listed_at", "deleted_at"),
    ]


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return orphans(table(spark, d, "yelp_train"), "row_no", F.coalesce("rated_at", "loaded_at"), _targets(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("row_no", "ref_column", "kind")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_cases(spark, d))


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """How far parent keys compress: parents, runs, longest run, references and those matched, per referring column."""
    return run_report(table(spark, d, "yelp_train"), _targets(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(table(spark, d, "yelp_user"), "arrival_no", ["friends", "elite"])


def p6_item_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("field_name", "item").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


def p6_readings(spark: SparkSession, d: str) -> DataFrame:
    """Per field: strings, strings with more than one reading, and readings the check had to mend."""
    return reading_report(table(spark, d, "yelp_user"), "arrival_no", ["friends", "elite"])


QUERIES = {f.__name__: f for f in (p2_found, p2_by_month, p2_runs, p6_found, p6_item_counts, p6_readings)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_P2 = f"""
WITH u AS (SELECT trim(user_id, {_BLANK}) k, min(arrived_at) a, min(deleted_at) x FROM yelp_user WHERE trim(user_id, {_BLANK}) <> '' GROUP BY 1),
b AS (SELECT trim(business_id, {_BLANK}) k, min(listed_at) a, min(deleted_at) x FROM business WHERE trim(business_id, {_BLANK}) <> '' GROUP BY 1),
r AS (SELECT row_no, 'user_id' AS ref_column, trim(user_id, {_BLANK}) k, coalesce(rated_at, loaded_at) t FROM yelp_train
      UNION ALL SELECT row_no, 'business_id', trim(business_id, {_BLANK}), coalesce(rated_at, loaded_at) FROM yelp_train),
j AS (SELECT r.*, coalesce(u.k, b.k) AS hit, coalesce(u.a, b.a) AS a, coalesce(u.x, b.x) AS x FROM r
      LEFT JOIN u ON r.ref_column = 'user_id' AND u.k = r.k LEFT JOIN b ON r.ref_column = 'business_id' AND b.k = r.k WHERE r.k <> ''),
c AS (SELECT row_no, ref_column, 'missing' AS kind, t FROM j WHERE hit IS NULL
      UNION ALL SELECT row_no, ref_column, 'late', t FROM j WHERE hit IS NOT NULL AND t < a
      UNION ALL SELECT row_no, ref_column, 'deleted', t FROM j WHERE hit IS NOT NULL AND t >= x)
"""
# quoted spans and what lies between them are told apart first; separators outside spans become chr(1), spans start with chr(2)
_P6 = rf"""
WITH f AS (SELECT arrival_no, 'friends' AS field_name, trim(friends, {_BLANK}) s FROM yelp_user
           UNION ALL SELECT arrival_no, 'elite', trim(elite, {_BLANK}) FROM yelp_user),
g AS (SELECT arrival_no, field_name, CASE WHEN length(s) > 1 AND s[1] = '[' AND s[-1] = ']' THEN trim(s[2:-2], {_BLANK}) ELSE s END s FROM f WHERE s <> ''),
m AS (SELECT arrival_no, field_name, regexp_extract_all(s, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^"'']+') xs FROM g),
c AS (SELECT arrival_no, field_name, string_split(array_to_string(list_transform(xs, lambda x: CASE WHEN x[1] IN ('"', '''') THEN chr(2) || replace(x[2:-2], x[1] || x[1], x[1])
           ELSE regexp_replace(x, '\s*[^\w\s-]\s*|\s+', chr(1), 'g') END), ''), chr(1)) AS vs FROM m),
e AS (SELECT arrival_no, field_name, CAST(generate_subscripts(vs, 1) AS BIGINT) AS pos, unnest(vs) AS v FROM c),
p6 AS (SELECT arrival_no, field_name, pos, CASE WHEN v[1] = chr(2) THEN v[2:] ELSE v END AS item FROM e WHERE v <> '' AND lower(v) NOT IN ('none', 'null', '-'))
"""

ORACLES = {
    "p2_found": _P2 + "SELECT row_no, ref_column, kind FROM c",
    "p2_by_month": _P2 + "SELECT ref_column, kind, strftime(t, '%Y-%m') AS month, count(*) AS n FROM c GROUP BY 1, 2, 3",
    "p6_found": _P6 + "SELECT * FROM p6",
    "p6_item_counts": _P6 + "SELECT field_name, item, count(*) AS n, max(pos) AS last_pos FROM p6 GROUP BY 1, 2",
}
