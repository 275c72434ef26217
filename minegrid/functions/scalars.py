"""Scalar building blocks as column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes that count towards a business's score.
SCORED_ATTRIBUTES = (
    "OutdoorSeating", "RestaurantsDelivery", "RestaurantsGoodForGroups", "RestaurantsReservations",
    "RestaurantsTakeOut", "BikeParking", "BusinessAcceptsCreditCards", "GoodForKids", "HasTV",
)


def list_length(col: Column) -> Column:
    """Parts of a comma-separated string; '' and 'None' count one, null none."""
    return F.when(col.isNotNull(), F.size(F.split(col, ","))).otherwise(0)


def years_until(col: Column, year: int = 2023) -> Column:
    """``year`` less the year at the start of a date string; null where there is none."""
    return F.lit(year) - F.substring(col, 1, 4).try_cast("int")


def total(cols: Sequence[str]) -> Column:
    """Sum of counters, nulls as 0."""
    out = F.lit(0).cast("bigint")
    for c in cols:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def number_at(attributes: Column, key: str) -> Column:
    """A numeric map entry, 0 where it is absent or no number."""
    return F.coalesce(F.try_element_at(attributes, F.lit(key)).try_cast("double"), F.lit(0.0))


def flag_at(attributes: Column, key: str) -> Column:
    """1 if the map has the key with a value other than 'False'."""
    v = F.try_element_at(attributes, F.lit(key))
    return F.when(v.isNotNull() & (v != "False"), 1).otherwise(0)


def attribute_score(attributes: Column, keys: Sequence[str] = SCORED_ATTRIBUTES) -> Column:
    out = F.lit(0)
    for k in keys:
        out = out + flag_at(attributes, k)
    return out


def safe_ratio(num: Column, den: Column, otherwise: Column | float = 0.0) -> Column:
    other = F.lit(otherwise) if isinstance(otherwise, float) else otherwise
    return F.when(den != 0, num / den).otherwise(other)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def bytes_mod(col: Column, p: int) -> Column:
    """The string's UTF-8 bytes, read as one big-endian number, modulo p (p < 2^55)."""
    hexed = F.hex(F.encode(col, "UTF-8"))
    digits = F.transform(F.sequence(F.lit(0), F.floor(F.length(hexed) / 2).cast("int") - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(F.length(col) > 0, F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, x: (acc * 256 + x) % p)).otherwise(F.lit(0).cast("bigint"))


def linear_hash(x: Column, a: int, b: int, p: int, m: int | Column) -> Column:
    """((a x + b) mod p) mod m."""
    return ((x * a + b) % p) % m


def trailing_zeros(h: Column) -> Column:
    """Trailing zeros of the binary form; 0 counts 3, as its printed form has no 1 to stop at."""
    b = F.bin(h)
    return F.when(h == 0, 3).otherwise(F.length(b) - F.length(F.rtrim(b, F.lit("0"))))


def hash_family(n: int, p: int, seed: int = 1) -> list[tuple[int, int]]:
    """n fixed (a, b) pairs below p, drawn by a multiplicative generator from ``seed``."""
    out, x = [], seed
    for _ in range(n):
        a = x = x * 48271 % 2147483647
        b = x = x * 48271 % 2147483647
        out.append((a % (p - 1) + 1, b % p))
    return out
