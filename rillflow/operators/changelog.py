"""Change envelopes and changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENVELOPE = "op string, before map<string,string>, after map<string,string>, source struct<db:string,`table`:string>"
#: Fixed: operation letters of change envelopes.
OPERATIONS = {"c": "insert", "r": "insert", "u": "update", "d": "delete"}


def normalise_cdc(df: DataFrame, column: str) -> DataFrame:
    """(database, table_name, before, after, type) beside the other columns; a missing image is an empty map."""
    e = F.from_json(column, ENVELOPE)
    empty = F.create_map().cast("map<string,string>")
    kind = F.lit(None).cast("string")
    for letter, name in OPERATIONS.items():
        kind = F.when(F.col("__e.op") == letter, name).otherwise(kind)
    out = df.withColumn("__e", e)
    return out.select(
        *[c for c in df.columns if c != column], F.col("__e.source.db").alias("database"), F.col("__e.source.table").alias("table_name"),
        F.coalesce("__e.before", empty).alias("before"), F.coalesce("__e.after", empty).alias("after"), kind.alias("type"),
    )


def apply_changelog(df: DataFrame, keys: list[str], seq: str, deleted: Column) -> DataFrame:
    """The table a changelog leaves: the last change of each key, unless it deletes."""
    columns = [c for c in df.columns if c not in keys]
    last = df.withColumn("__gone", deleted).groupBy(*keys).agg(F.max_by(F.struct(*columns, "__gone"), seq).alias("__r"))
    return last.where("not __r.__gone").select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])


def latest_values(df: DataFrame, key: str, value: str, offset: str) -> DataFrame:
    """A keyed topic as a table: the value of greatest offset, keys whose last value is null gone."""
    return df.groupBy(key).agg(F.max_by(F.struct(value), offset).alias("__v")).select(key, F.col(f"__v.{value}").alias(value)).where(F.col(value).isNotNull())


def emit_changelog(df: DataFrame, keys: list[str], order_by: list[str], agg: Column, name: str) -> DataFrame:
    """The changelog of a running aggregate: +I for a key's first row, then -U with the old and +U with the new value."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    run = df.withColumn("__v", agg.over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("__old", F.lag("__v").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    first = F.array(F.struct(F.lit("+I").alias("op"), F.col("__v").alias(name)))
    pair = F.array(F.struct(F.lit("-U").alias("op"), F.col("__old").alias(name)), F.struct(F.lit("+U").alias("op"), F.col("__v").alias(name)))
    return run.withColumn("__c", F.explode(F.when(F.col("__first"), first).otherwise(pair))).select(*keys, *order_by, "__c.*")


def outer_join_changelog(left: DataFrame, right: DataFrame, on: str, left_seq: str, right_seq: str) -> DataFrame:
    """The changelog of a left join whose sides arrive row by row: the left columns, the right ones, ``op`` and ``seq``.

    ``on`` is unique on the left. A left row that comes before all its matches is first sent with nulls (+I) and taken
    back by the first of them (-D); each pair is sent when the later of its rows is there. Rows with a null ``on`` match
    nothing.
    """
    own = [c for c in right.columns if c != on]
    none = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in own]
    pairs = left.join(right, on).select(*left.columns, *own, F.lit("+I").alias("op"), F.greatest(left_seq, right_seq).alias("seq"))
    alone = left.join(right.groupBy(on).agg(F.min(right_seq).alias("__first")), on, "left").where(F.col("__first").isNull() | (F.col("__first") > F.col(left_seq)))
    sent = F.array(F.struct(F.lit("+I").alias("op"), F.col(left_seq).alias("seq")), F.struct(F.lit("-D").alias("op"), F.col("__first").alias("seq")))
    alone = alone.select(*left.columns, *none, F.inline(F.filter(sent, lambda c: c["seq"].isNotNull())))
    return pairs.unionByName(alone)
