"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the membership bitmap: 8 MB whatever the input; a full one only lets more rows through.
BITMAP_BITS = 1 << 26
#: Spark's setting that a query's shuffle files are deleted at its end, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIRS: dict[str, str] = {}
#: Folders that cut() wrote and nothing has deleted yet, oldest first.
_WRITTEN: dict[str, None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one where that is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIRS[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: ends lineage, survives executor loss. Its shuffle files
    go with the write, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillflow-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    _WRITTEN[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    for df in cuts:
        _delete(df.sparkSession, df._cut_path)


def written() -> list[str]:
    """The folders of ``cut`` that are left."""
    return list(_WRITTEN)


def drop_written(spark: SparkSession, keep: list[str]) -> None:
    """Delete the folders of ``cut`` that aren't in ``keep``, once nothing reads them any more."""
    for path in written():
        if path not in keep:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def by_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def free_name(*frames: DataFrame) -> str:
    """A column name that none of ``frames`` has."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(name for n in range(len(taken) + 1) if (name := f"_own{n}") not in taken)


def row_key() -> F.Column:
    """A key for (doc_id, text) that is never null: equal rows share it, so results found by key can be joined back."""
    return F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x02")), F.coalesce("text", F.lit("\x03"))))


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of BITMAP_BITS bits of the 64-bit ``column``: at most 2^20 words reach the driver, whatever the input."""
    bit = F.col(column).bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = (
        hashes.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    out = np.zeros(BITMAP_BITS >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.astype(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def sha_of(parts: F.Column) -> F.Column:
    return F.sha2(parts, 256)
