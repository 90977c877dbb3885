"""Operators on each key's rows in order: visits, bounces, patterns, previous values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_concat(df: DataFrame, keys: list[str], order_by: list[str], value: str, name: str = "joined") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.array_join(F.collect_list(value).over(w), ""))


def prev_value(df: DataFrame, keys: list[str], order_by: list[str], value: str, name: str = "joined") -> DataFrame:
    """previous:UPPER(current); the first row of a key has null before the colon."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(name, F.concat(F.coalesce(F.lag(value).over(w), F.lit("null")), F.lit(":"), F.upper(value)))


def repair_is_new(df: DataFrame, key: str, order_by: list[str], flag: str = "is_new") -> DataFrame:
    """The flag stays 1 on a key's first row that claims it; later claims become 0, other rows stay."""
    claims = F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(flag, F.when((F.col(flag) == 1) & (claims > 1), 0).otherwise(F.col(flag)))


def daily_first(df: DataFrame, key: str, ts: str, order_by: list[str], is_entry: Column, zone: str = "UTC") -> DataFrame:
    """Entry rows whose day differs from the day of the key's entry row before."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    w = Window.partitionBy(key).orderBy(*order_by)
    entries = df.where(is_entry).withColumn("day", day)
    return entries.withColumn("__b", F.lag("day").over(w)).where("__b is null or __b <> day").drop("__b")


def bounce(df: DataFrame, key: str, ts: str, order_by: list[str], is_entry: Column, within_s: int) -> DataFrame:
    """Entry rows after which the key's next row is an entry too, or comes too late, or never comes."""
    w = Window.partitionBy(key).orderBy(*order_by)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    seen = df.withColumn("__e", is_entry).withColumn("__us", at)
    seen = seen.withColumn("__ne", F.lead("__e").over(w)).withColumn("__nu", F.lead("__us").over(w))
    gone = F.col("__nu").isNull() | F.col("__ne") | (F.col("__nu") - F.col("__us") >= within_s * 1_000_000)
    return seen.where(F.col("__e") & gone).drop("__e", "__us", "__ne", "__nu")


def consecutive(df: DataFrame, key: str, ts: str, order_by: list[str], matches: Column, n: int, within_s: int) -> DataFrame:
    """Rows that begin ``n`` strictly consecutive matches of a key, the last less than ``within_s`` seconds after the first."""
    w = Window.partitionBy(key).orderBy(*order_by)
    seen = df.withColumn("__m", matches).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    ok = F.col("__m")
    for k in range(1, n):
        ok = ok & F.coalesce(F.lead("__m", k).over(w), F.lit(False))
    near = F.lead("__us", n - 1).over(w) - F.col("__us") < within_s * 1_000_000
    return seen.withColumn("__ok", ok & near).where("__ok").drop("__m", "__us", "__ok")


def pattern_pair(df: DataFrame, key: str, order_by: list[str], action: str, patterns: DataFrame, last_wins: str | None = None) -> DataFrame:
    """Rows where the key's previous action and this one make a pattern (first, second). ``last_wins``: a column of the
    patterns; only the pattern greatest in it counts."""
    if last_wins:
        patterns = patterns.orderBy(F.desc(last_wins)).limit(1)
    before = F.lag(action).over(Window.partitionBy(key).orderBy(*order_by))
    pairs = df.withColumn("before", before)
    return pairs.join(patterns, (pairs["before"] == patterns["first"]) & (pairs[action] == patterns["second"])).select(*df.columns, "before")


def periodic_count(df: DataFrame, key: str, ts: str, order_by: str, period_s: int) -> DataFrame:
    """(key, fired_us, n): the cumulative count of a key, sent a period after the first row that no timer waits for.

    Whether a row sets a timer depends on the one before that did, so each key is read in order: rows are dealt by key,
    sorted by Spark, and read batch by batch; only (key, count, timer) is held. Rows without a time count for no timer.
    """
    kind = df.schema[key].dataType
    slim = df.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order_by).alias("o")).where("us is not null")
    dealt = slim.repartition("key").sortWithinPartitions("key", "o").drop("o")

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, due = None, 0, None
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("us").to_pylist()):
                if k != now or not n:
                    if due is not None:
                        out.append((now, due, n))
                    now, n, due = k, 0, None
                if due is not None and t >= due:
                    out.append((k, due, n))
                    due = None
                if due is None:
                    due = t + period_s * 1_000_000
                n += 1
            if out:
                yield _rows(out, batch.column("key").type)
        if due is not None:
            yield _rows([(now, due, n)], batch.column("key").type)

    def _rows(out: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        k, us, n = zip(*out)
        return pa.record_batch({"key": pa.array(k, key_type), "fired_us": pa.array(us, pa.int64()), "n": pa.array(n, pa.int64())})

    return dealt.mapInArrow(fire, f"key {kind.simpleString()}, fired_us long, n long").withColumnRenamed("key", key)
