"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_hash(value: str | Column) -> Column:
    """The 31-polynomial string hash with 32-bit wrap, of texts whose characters are in the basic plane."""
    chars = F.when(F.length(value) > 0, F.split(value, "")).otherwise(F.array().cast("array<string>"))
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    step = lambda h, c: wrap(h * F.lit(31) + F.ascii(c).cast("long"))
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), step).cast("int")


def to_millis(text: str | Column, zone: str = "+08:00", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text of a local time in ``zone`` as epoch milliseconds."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(text, pattern), zone))


def from_millis(millis: str | Column, zone: str = "+08:00", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    ms = F.col(millis) if isinstance(millis, str) else millis
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), pattern)


def age(birthday: str | Column, as_of: Column) -> Column:
    return F.floor(F.datediff(as_of, birthday) / 365).cast("int")


def window_floor(millis: str | Column, size_ms: int) -> Column:
    ms = F.col(millis) if isinstance(millis, str) else millis
    return F.floor(ms / size_ms) * size_ms


def merge_rows(new: list[str], old: list[str]) -> list[Column]:
    """The first of each pair that isn't null, under the new name."""
    return [F.coalesce(a, b).alias(a) for a, b in zip(new, old)]


def tokens(text: str | Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
