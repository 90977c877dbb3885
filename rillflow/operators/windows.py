"""Time, session, cumulating and count windows over batch or streaming frames."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _out(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    names = [c for c in df.columns if c != "__w"]
    return df.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *names)


def tumble(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    return _out(df.groupBy(F.window(ts, size).alias("__w"), *keys).agg(*aggs), keys, aggs)


def hop(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    return _out(df.groupBy(F.window(ts, size, slide).alias("__w"), *keys).agg(*aggs), keys, aggs)


def session(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    return _out(df.groupBy(F.session_window(ts, gap).alias("__w"), *keys).agg(*aggs), keys, aggs)


def cumulate(df: DataFrame, ts: str, step_s: int, size_s: int, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    """Windows that share a start every ``size_s`` seconds and grow by ``step_s``; a row counts in each that ends after it.

    On a stream, ``delay`` sets the watermark on the window end, which the rows carry from the start.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    base = F.floor(at / (size_s * 1_000_000)) * size_s
    first = F.floor(at / (step_s * 1_000_000)) * step_s + step_s
    wide = df.withColumn("__base", base).withColumn("__end", F.explode(F.sequence(first, base + size_s, F.lit(step_s).cast("long"))))
    wide = wide.withColumn("window_start", F.timestamp_seconds("__base")).withColumn("window_end", F.timestamp_seconds("__end"))
    if delay:
        wide = wide.withWatermark("window_end", delay)
    return wide.groupBy("window_start", "window_end", *keys).agg(*aggs)


def count_window(df: DataFrame, keys: list[str], order_by: list[str], n: int, slide: int | None = None) -> DataFrame:
    """Rows with the number of the count window (from 1) they belong to.

    Tumbling: windows of ``n`` rows, a tail of fewer never fires. Sliding: every ``slide`` rows a window over the last
    ``n`` at most fires; a row comes once for each window it is in.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    numbered = df.withColumn("__rn", F.row_number().over(w)).withColumn("__all", F.count("*").over(Window.partitionBy(*keys)))
    if slide is None:
        fired = F.floor(F.col("__all") / n)
        return numbered.withColumn("window_no", F.floor((F.col("__rn") - 1) / n) + 1).where(F.col("window_no") <= fired).drop("__rn", "__all")
    first, last = F.ceil(F.col("__rn") / slide), F.least(F.floor((F.col("__rn") + n - 1) / slide), F.floor(F.col("__all") / slide))
    return numbered.withColumn("window_no", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).drop("__rn", "__all")


#: Rows of a piece of the order that a running maximum is taken in, about.
PIECE_ROWS = 1_000_000


def high_water(df: DataFrame, value: Column, order_by: str, into: str, own: bool = True) -> DataFrame:
    """``df`` with the greatest ``value`` of all rows up to its own (or only before it) in the order of a number.

    The order is cut at quantiles into as many pieces as the rows ask for, so an outlier makes no large piece. Within a
    piece a window runs over its rows; what came before it is the running maximum of the pieces' own, so one row for
    each piece meets in one task. Rows without an order come first.
    """
    pieces = -(-df.count() // PIECE_ROWS)
    edges = sorted(set(df.approxQuantile(order_by, [k / pieces for k in range(1, pieces)], 0.25 / pieces))) if pieces > 1 else []
    piece = F.lit(0)
    if edges:
        place = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="__order", outputCol="__place", handleInvalid="keep")
        df = place.transform(df.withColumn("__order", F.col(order_by).cast("double"))).drop("__order")
        piece = F.when(F.col(order_by).isNull(), F.lit(-1)).otherwise(F.col("__place").cast("int"))
    marked = df.withColumn("__value", value).withColumn("__piece", piece).drop("__place")
    tops = marked.groupBy("__piece").agg(F.max("__value").alias("__top"))
    before = tops.withColumn("__before", F.max("__top").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    within = F.max("__value").over(Window.partitionBy("__piece").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    seen = marked.withColumn("__in", within).join(before, "__piece").withColumn(into, F.greatest("__in", "__before"))
    return seen.drop("__value", "__piece", "__in", "__before")


def late_split(df: DataFrame, ts: str, arrival: str, size_s: int, delay_s: int, lateness_s: int = 0) -> tuple[DataFrame, DataFrame]:
    """(main, late) of rows in arrival order: late ones come when the watermark (greatest time before them less the
    delay) has passed their window's end and the allowed lateness."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = high_water(df, micros, arrival, "__seen", own=False)
    end = (F.floor(micros / (size_s * 1_000_000)) + 1) * (size_s * 1_000_000)
    late = F.coalesce(end + lateness_s * 1_000_000 <= F.col("__seen") - delay_s * 1_000_000, F.lit(False))
    tagged = seen.withColumn("__late", late).drop("__seen")
    return tagged.where("not __late").drop("__late"), tagged.where("__late").drop("__late")


def refire(df: DataFrame, keys: list[str], ts: str, arrival: str, size_s: int, delay_s: int, lateness_s: int) -> DataFrame:
    """What windows that wait for late rows send: a count when the watermark first passes a window's end, and one more
    for each later row until the watermark passes the end and the allowed lateness; rows after that are dropped.

    The watermark is the greatest time before a row, in the order of arrival, less the delay. It never falls, so a window's
    late rows all follow the others: these are only counted, and the late ones numbered. Columns: keys, window_end,
    fired ('on time' or 'late'), arrived (null for the first count), n. ``arrival`` has no ties; rows without a time belong
    to no window.
    """
    size, delay, lateness = size_s * 1_000_000, delay_s * 1_000_000, lateness_s * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = high_water(df, micros, arrival, "__seen", own=False)
    marked = seen.withColumn("__end", (F.floor(micros / size) + 1) * size).withColumn("__mark", F.col("__seen") - delay)
    held = marked.where("__end is not null").where(F.coalesce(F.col("__end") + lateness > F.col("__mark"), F.lit(True)))
    held = held.select(*keys, F.col(arrival).alias("arrived"), "__end", F.coalesce(F.col("__end") <= F.col("__mark"), F.lit(False)).alias("__late"))
    first = held.where("not __late").groupBy(*keys, "__end").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "__end").orderBy("arrived")
    late = held.where("__late").withColumn("__k", F.row_number().over(w)).alias("late")
    both = late.join(first.alias("first"), [F.col(f"late.{c}").eqNullSafe(F.col(f"first.{c}")) for c in (*keys, "__end")], "left")
    again = both.select(*[F.col(f"late.{c}") for c in (*keys, "__end")], F.lit("late").alias("fired"), "arrived", (F.coalesce("n", F.lit(0)) + F.col("__k")).alias("n"))
    once = first.select(*keys, "__end", F.lit("on time").alias("fired"), F.lit(None).cast(df.schema[arrival].dataType).alias("arrived"), "n")
    return once.unionByName(again).withColumn("window_end", F.timestamp_micros("__end")).drop("__end")


def marker_trigger(df: DataFrame, keys: list[str], ts: str, arrival: str, size: str, is_marker: Column) -> DataFrame:
    """Counts of the rows that aren't markers in each key's window: one at each marker so far, and one at the end.

    Markers are evicted from the counts. Columns: keys, window bounds, fired ('marker' or 'end'), at (arrival; null at
    the end), n.
    """
    rows = df.withColumn("__w", F.window(ts, size)).withColumn("__m", F.coalesce(is_marker, F.lit(False)))
    w = Window.partitionBy(*keys, "__w").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("n", F.sum(F.when(F.col("__m"), 0).otherwise(1)).over(w))
    bounds = [F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end")]
    early = run.where("__m").select(*keys, *bounds, F.lit("marker").alias("fired"), F.col(arrival).cast("long").alias("at"), "n")
    end = rows.groupBy(*keys, "__w").agg(F.count(F.when(~F.col("__m"), 1)).alias("n"))
    return early.unionByName(end.select(*keys, *bounds, F.lit("end").alias("fired"), F.lit(None).cast("long").alias("at"), "n"))
