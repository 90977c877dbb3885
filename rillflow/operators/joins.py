"""Window, interval, as-of, range and enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, size: str, how: str = "inner") -> DataFrame:
    """Rows of equal key and equal tumbling window; ``how`` is any join type. The window is window_start, window_end."""
    a = left.withColumn("__w", F.window(left_ts, size))
    b = right.withColumn("__w", F.window(right_ts, size))
    joined = a.join(b, [*on, "__w"], how)
    names = [c for c in joined.columns if c not in (*on, "__w")]
    return joined.select(*on, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *names)


def cogroup_lists(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, size: str, left_value: str, right_value: str) -> DataFrame:
    """Both sides of each key and window as sorted lists, empty where a side has no row."""
    a = left.groupBy(*on, F.window(left_ts, size).alias("__w")).agg(F.sort_array(F.collect_list(left_value)).alias("left_rows"))
    b = right.groupBy(*on, F.window(right_ts, size).alias("__w")).agg(F.sort_array(F.collect_list(right_value)).alias("right_rows"))
    none = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    both = a.join(b, [*on, "__w"], "full")
    return both.select(*on, F.col("__w.start").alias("window_start"), none(a, "left_rows").alias("left_rows"), none(b, "right_rows").alias("right_rows"))


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_ts: str, right_ts: str, low: str, high: str, how: str = "inner", cell_s: int | None = None) -> DataFrame:
    """Rows of equal keys with left_ts + low <= right_ts <= left_ts + high (interval texts, ends included).

    ``cell_s``: deal the rows by cells of so many seconds beside the key, where a key holds many rows. Column names of
    the sides differ.
    """
    within = (F.col(right_ts) >= F.col(left_ts) + F.expr(f"interval {low}")) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {high}"))
    cond = within
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    if cell_s:
        cell = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / cell_s)
        ts = F.col(left_ts)
        left = left.withColumn("__lc", F.explode(F.sequence(cell(ts + F.expr(f"interval {low}")), cell(ts + F.expr(f"interval {high}")))))
        right = right.withColumn("__rc", cell(F.col(right_ts)))
        return left.join(right, cond & (F.col("__lc") == F.col("__rc")), how).drop("__lc", "__rc")
    return left.join(right, cond, how)


def asof_join(left: DataFrame, versions: DataFrame, on: list[str], left_ts: str, version_ts: str, columns: list[str]) -> DataFrame:
    """Each left row with the latest version of its key that isn't later than it; null where there is none.

    One shuffle: both sides are laid in time order for each key and the last version is carried forward.
    """
    names = left.columns
    a = left.select(*names, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(versions.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("__v"))
    b = versions.select(*[F.col(c) if c in on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.col(version_ts).alias("__t"), F.lit(0).alias("__side"), F.struct(*columns).alias("__v"))
    w = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select(*names, *[F.col(f"__v.{c}").alias(c) for c in columns])


def range_lookup(df: DataFrame, rules: DataFrame, value: str, low: str, high: str, cell: int, default: dict[str, Column], max_cells: int = 4096, levels: int | None = None) -> DataFrame:
    """Each row with the rule whose range (ends included) holds its value, or the default; ranges do not overlap.

    Ranges are laid over cells and meet values by equality. A range that would span more than ``max_cells`` cells goes to
    a level whose cells are ``max_cells`` times as wide, and so on, up to any range of 64-bit numbers; each level is one
    join. ``levels``: where ranges are known to be no wider than so many levels take, only these are joined (the last one
    takes what is wider still). Nothing is read while the plan is made. Rows with a null value and rules with a null bound
    match nothing.
    """
    wide = [float(cell)]
    while wide[-1] * max_cells < 2.0**64 and len(wide) != levels:
        wide.append(wide[-1] * max_cells)
    at = lambda c, size: F.floor(F.col(c) / F.lit(size))
    level = sum((F.when(at(high, size) - at(low, size) >= max_cells, 1).otherwise(0) for size in wide[:-1]), F.lit(0))
    used, out = range(len(wide)), df
    for k in used:
        name = lambda c, k=k: f"__{k}_{c}"
        cells = F.explode(F.sequence(at(low, wide[k]), at(high, wide[k]))).alias(name("cell"))
        own = rules.where(level == k).select(cells, *[F.col(c).alias(name(c)) for c in rules.columns])
        fits = (F.col(value) >= F.col(name(low))) & (F.col(value) <= F.col(name(high)))
        out = out.join(own, (at(value, wide[k]) == F.col(name("cell"))) & fits, "left")
    found = [F.coalesce(*[F.col(f"__{k}_{c}") for k in used], *([default[c]] if c in default else [])).alias(c) for c in rules.columns]
    return out.select(*df.columns, *found)


def enrich(df: DataFrame, dims: list[tuple[DataFrame, str, str, dict[str, str]]]) -> DataFrame:
    """Left joins to dimensions in turn: (dimension, foreign key, its key, {column: alias}); a later one may use what an
    earlier one added. A miss leaves nulls. Spark broadcasts a dimension by its measured size."""
    for dim, foreign, key, columns in dims:
        own = dim.select(F.col(key).alias("__k"), *[F.col(c).alias(a) for c, a in columns.items()])
        df = df.join(own, df[foreign] == own["__k"], "left").drop("__k")
    return df


def enrich_split(df: DataFrame, dim: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(hit, miss): rows with what the dimension has on them, and rows it doesn't know."""
    hit = df.join(dim, on)
    return hit, df.join(dim, on, "left_anti")


def reconcile(a: DataFrame, b: DataFrame, on: str, a_ts: str, b_ts: str, within_s: int) -> DataFrame:
    """(key, status): matched where both sides come within so many seconds, else which side misses the other."""
    x = a.select(F.col(on).alias("key"), F.col(a_ts).alias("__a"))
    y = b.select(F.col(on).alias("__key"), F.col(b_ts).alias("__b"))
    near = F.abs(F.unix_micros(F.col("__a").cast("timestamp")) - F.unix_micros(F.col("__b").cast("timestamp"))) <= within_s * 1_000_000
    both = x.join(y, (F.col("key") == F.col("__key")) & near, "full")
    status = F.when(F.col("__key").isNull(), "right missing").when(F.col("key").isNull(), "left missing").otherwise("matched")
    return both.select(F.coalesce("key", "__key").alias("key"), status.alias("status"))
