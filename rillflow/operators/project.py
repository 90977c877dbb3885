"""Projection, parsing and routing. Every function works on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_json(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(clean, dirty): rows whose text is a JSON object with its fields beside the other columns, and the rest as they are."""
    parsed = df.withColumn("__v", F.try_parse_json(column))
    ok = F.col("__v").isNotNull() & F.col(column).rlike(r"^\s*\{")
    clean = parsed.where(ok).withColumn("__p", F.from_json(column, schema)).select(*df.columns, "__p.*")
    return clean, parsed.where(~F.coalesce(ok, F.lit(False))).drop("__v")


def only_json(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.try_parse_json(column).isNotNull())


def event_day(df: DataFrame, column: str, path: str = "$.ts", unit_ms: int = 1, zone: str = "UTC") -> DataFrame:
    """dt from an epoch inside a JSON text, in units of ``unit_ms`` milliseconds."""
    millis = F.get_json_object(column, path).cast("long") * unit_ms
    return df.withColumn("dt", F.date_format(F.from_utc_timestamp(F.timestamp_millis(millis), zone), "yyyy-MM-dd"))


def route(df: DataFrame, rules: dict[str, Column], rest: str = "main") -> DataFrame:
    """A ``route`` column: the first rule that holds, else ``rest``. One pass; each output is a filter of it."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return df.withColumn("route", F.coalesce(out, F.lit(rest)))


def split(df: DataFrame, rules: dict[str, Column], rest: str = "main") -> dict[str, DataFrame]:
    tagged = route(df, rules, rest)
    return {name: tagged.where(F.col("route") == name).drop("route") for name in [*rules, rest]}


def multi_emit(df: DataFrame, outputs: list[tuple[Column | None, Column]], name: str = "out") -> DataFrame:
    """Each row gives each output whose condition holds (None: always), in order, as ``name`` with its ``pos``."""
    each = F.array(*[F.when(F.lit(True) if c is None else F.coalesce(c, F.lit(False)), F.struct(v.alias("v"))) for c, v in outputs])
    flat = df.select("*", F.posexplode(F.array_compact(each)).alias("pos", "__o"))
    return flat.withColumn(name, F.col("__o.v")).drop("__o")


def replicate(df: DataFrame, times: str, copy: str = "copy") -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1; none for zero, negative or null."""
    n = F.greatest(F.coalesce(F.col(times).cast("int"), F.lit(0)), F.lit(0))
    return df.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))


def flatten(df: DataFrame, column: str, fields: list[str], at_most: int | None = None, prefix: str = "") -> DataFrame:
    """An array of structs as rows beside the parent columns, of rows with at most so many elements."""
    some = df if at_most is None else df.where(F.size(column) <= at_most)
    return some.withColumn("__e", F.explode(column)).select(*[c for c in df.columns if c != column], *[F.col(f"__e.{f}").alias(prefix + f) for f in fields])


def app_log(df: DataFrame) -> DataFrame:
    """Rows of an app log as (kind, page_id, item, ...): ``start`` where that is filled, else ``page``, and a ``display``
    row for each element of displays, with the page it was shown on."""
    kind = F.when(F.coalesce(F.length("start"), F.lit(0)) > 0, "start").otherwise("page")
    tagged = df.withColumn("kind", kind)
    shown = tagged.where("kind = 'page'").withColumn("item", F.explode("displays")).withColumn("kind", F.lit("display"))
    return tagged.withColumn("item", F.lit(None).cast("string")).unionByName(shown).drop("start", "displays")


def route_by_config(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes (table_name, op, after map) joined to rows of configuration (source_table, operate_type, sink_type,
    sink_table, sink_columns): only the configured columns of ``after`` stay, changes without a row go, deletes go first.

    The configuration is one row for each table and operation; it is joined on both. It is always broadcast: by its few
    keys all changes of a table would meet in one task.
    """
    kept = changes.where("op <> 'delete'")
    on = (kept["table_name"] == config["source_table"]) & (kept["op"] == config["operate_type"])
    wide = kept.join(F.broadcast(config), on)
    columns = F.split("sink_columns", ",")
    return wide.select(*changes.columns[:-1], F.map_filter("after", lambda k, _: F.array_contains(columns, k)).alias("after"), "sink_type", "sink_table")


def create_table_sql(name: str, columns: str, key: str | None = None, extend: str | None = None) -> str:
    """DDL of a sink table from its row of configuration: all columns strings, ``id`` the default key."""
    key = key or "id"
    body = ", ".join(f"{c.strip()} STRING{' NOT NULL' if c.strip() == key else ''}" for c in columns.split(","))
    return f"CREATE TABLE IF NOT EXISTS {name} ({body}) {extend or 'USING parquet'}".strip()


def sink_schema(columns: str) -> StructType:
    out = StructType()
    for c in columns.split(","):
        out = out.add(c.strip(), "string")
    return out


def co_map(left: DataFrame, right: DataFrame, left_out: Column, right_out: Column, name: str = "out") -> DataFrame:
    """Two streams of unlike rows as one: a function for each side, and which side a row came from."""
    return left.select(F.lit("left").alias("side"), left_out.alias(name)).unionByName(right.select(F.lit("right").alias("side"), right_out.alias(name)))


def union_measures(frames: list[tuple[DataFrame, dict[str, Column]]], keys: list[str], measures: list[str]) -> DataFrame:
    """Streams that each fill some measures as one frame of all, the others 0."""
    out = None
    for df, own in frames:
        row = df.select(*keys, *[own.get(m, F.lit(0)).cast("double").alias(m) for m in measures])
        out = row if out is None else out.unionByName(row)
    return out
