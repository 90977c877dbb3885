"""Aggregates in arrival order, argmax with stated ties, top-n and table aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_count(df: DataFrame, column: str, pattern: str = r"\s+") -> DataFrame:
    words = df.select(F.explode(F.split(column, pattern)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def rolling(df: DataFrame, keys: list[str], order_by: list[str], aggs: dict[str, Column], rows: int | None = None) -> DataFrame:
    """Each row with the aggregates so far (or over the last ``rows`` rows) of its key, in order of arrival."""
    w = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)
    return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})


def max_field(df: DataFrame, keys: list[str], field: str, arrival: str, others: list[str]) -> DataFrame:
    """The greatest value of a field; the other fields are the first row's."""
    return df.groupBy(*keys).agg(F.max(field).alias(field), *[F.min_by(c, arrival).alias(c) for c in others])


def max_row(df: DataFrame, keys: list[str], field: str, arrival: str, columns: list[str], later_wins: bool = False) -> DataFrame:
    """The whole row of the greatest value; of equal ones the first to arrive, or the last."""
    at = F.col(arrival) if later_wins else -F.col(arrival)
    best = F.max_by(F.struct(*columns), F.struct(F.col(field), at)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, "__r.*")


def sum_with_latest(df: DataFrame, keys: list[str], measure: Column, name: str, arrival: str, carried: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(measure.alias(name), *[F.max_by(c, arrival).alias(c) for c in carried])


def ratio(count: Column, distinct: Column) -> Column:
    """count / distinct, 0.0 where nothing was counted."""
    return F.coalesce(count / F.nullif(distinct, F.lit(0)), F.lit(0.0))


def weighted_average(value: str, weight: str) -> Column:
    """Whole-number weighted average: sum(value * weight) div sum(weight), null for no weight."""
    return F.expr(f"sum(cast({value} as bigint) * {weight}) div nullif(sum({weight}), 0)")


def top_n(df: DataFrame, keys: list[str], order_by: list[Column], n: int, rank: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def global_top_n(df: DataFrame, order_by: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n of all rows: a distributed top-k, and only those n rows are numbered in one task."""
    first = df.orderBy(*order_by).limit(n)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*order_by)))


def window_top_n(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column], rank_by: list[Column], n: int, slide: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of each key and window, and the n best of each window (and of each value of ``within``)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    per = df.groupBy(w.alias("__w"), *keys).agg(*aggs)
    per = per.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[c for c in per.columns if c != "__w"])
    return top_n(per, ["window_start", "window_end", *within], rank_by, n)


def struct_top_n(df: DataFrame, keys: list[str], score: str, columns: list[str], n: int) -> DataFrame:
    """(keys, rn, score, columns): the n greatest rows of each key by score, then columns. Spark keeps n rows of a key in
    each task before they meet; on a stream, ``streaming.changes.top_changes`` keeps them up."""
    return top_n(df, keys, [F.desc(score), *[F.desc(c) for c in columns]], n).select(*keys, "rn", score, *columns)


def top_two(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Table aggregate: the two greatest values of each key with their rank; a group of one gives one row."""
    return top_n(df.select(*keys, F.col(value).alias("value")), keys, [F.desc("value")], 2, "rank")


def every_n(df: DataFrame, keys: list[str], order_by: list[str], n: int, aggs: dict[str, Column]) -> DataFrame:
    """The running aggregates of each key at every n-th row; they keep accumulating."""
    at = Window.partitionBy(*keys).orderBy(*order_by)
    return rolling(df, keys, order_by, aggs).withColumn("rn", F.row_number().over(at)).where(F.col("rn") % n == 0)
