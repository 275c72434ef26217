"""Typed readers. Schemas are declared, never inferred, so a scan reads what it needs and nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


# The field names of the files
_COMPLIMENTS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")
SCHEMAS: dict[str, T.StructType] = {
    "review": _schema(review_id=_S, user_id=_S, business_id=_S, stars=_D, useful=_L, funny=_L, cool=_L, text=_S, date=_S),
    "business": _schema(business_id=_S, name=_S, address=_S, city=_S, state=_S, postal_code=_S, latitude=_D, longitude=_D, stars=_D, review_count=_L, is_open=_D, attributes=T.MapType(_S, _S), categories=_S),
    "user": _schema(user_id=_S, review_count=_L, yelping_since=_S, useful=_L, funny=_L, cool=_L, elite=_S, friends=_S, fans=_L, average_stars=_D, **{f"compliment_{c}": _L for c in _COMPLIMENTS}),
    "photo": _schema(business_id=_S, label=_S),
    "checkin": _schema(business_id=_S, time=T.MapType(_S, _L)),
    "tip": _schema(user_id=_S, business_id=_S, likes=_L),
    "basket": _schema(user_id=_S, business_id=_S),
    "rating": _schema(user_id=_S, business_id=_S, stars=_D),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as column ``value``."""
    return spark.read.text(path)


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a known kind; broken lines become all-null rows."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """CSV with a header line, quoted fields allowed."""
    return spark.read.schema(SCHEMAS[kind]).option("header", True).option("quote", '"').csv(path)


def read_transactions(spark: SparkSession, path: str, date: int = 0, customer: int = 1, product: int = 5) -> DataFrame:
    """Quoted retail CSV to (basket 'date-customer', product without leading zeros); columns are taken by position."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path)
    c = raw.columns
    return raw.select(F.concat_ws("-", F.col(f"`{c[date]}`"), F.col(f"`{c[customer]}`")).alias("basket"), F.col(f"`{c[product]}`").cast("bigint").cast("string").alias("product"))


def read_vectors(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """Headerless numeric CSV to (index, features): the first field is the index, fields before ``skip`` are left out."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts[0].cast("bigint").alias("index"), F.transform(F.slice(parts, skip + 1, F.size(parts)), lambda x: x.cast("double")).alias("features"))


def read_union(spark: SparkSession, paths: dict[str, str], kind: dict[str, str]) -> DataFrame:
    """Several JSON files as one table with a ``table_name`` column; columns a file lacks are null."""
    out = None
    for name, path in paths.items():
        df = read_json(spark, path, kind[name]).withColumn("table_name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
