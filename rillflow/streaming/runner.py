"""Running streams over files to their end, and what batch and stream need to agree."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import fresh_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a file of a stream that a table is laid out as, and rows for each partition of its state.
FILE_ROWS, STATE_ROWS = 1_000_000, 250_000


def as_stream(df: DataFrame, order_by: str, pieces: int = 4, path: str | None = None) -> DataFrame:
    """A table as a stream of files in order, in about ``pieces`` micro-batches; NTZ times become instants, as watermarks need.

    Files hold ranges of the order and are as many as the rows ask for; a stream reads files by their time of change, so
    each gets one that follows its place. A batch may end behind any file.
    """
    spark = df.sparkSession
    path = path or fresh_dir(spark)
    rows = df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
    each = max(1, -(-rows.count() // (pieces * FILE_ROWS)))
    rows.repartitionByRange(pieces * each, order_by).sortWithinPartitions(order_by).write.mode("append").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    last = int(time.time() * 1000)
    for k, file in enumerate(files):
        fs.setTimes(file, last - 100 * (len(files) - k), -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None, idle: bool = True) -> int:
    """Run all micro-batches there are; the number of the last one. The same checkpoint goes on where it ended.

    ``idle``: also batches without rows, which event-time timers and last windows need. A processor that keeps the clock
    asks for one more after each batch, so with these it would never end.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    query = (
        df.writeStream.outputMode(mode).foreachBatch(sink).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or fresh_dir(spark)).start()
    )
    query.awaitTermination()
    return max((p["batchId"] for p in query.recentProgress), default=-1)


def collected(df: DataFrame, mode: str = "append", idle: bool = True) -> DataFrame:
    """What a stream sends out, with the number of the batch that sent it."""
    spark = df.sparkSession
    path = fresh_dir(spark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    run_to_end(df, sink, mode, idle=idle)
    return spark.read.parquet(path).drop("b")


@contextmanager
def state_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Streams that start in here have state for so many rows: each partition of it is a store that every batch opens and
    commits, which costs far more than a row, so there are as many as the cores or as the rows ask for, not as any shuffle has."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def with_sentinel(df: DataFrame, ts: str, order_by: str, days: int = 3650) -> DataFrame:
    """The rows and one far later, last in order, with nulls else: it lets a stream in append mode close all windows of
    the real rows, which ``availableNow`` alone doesn't."""
    last = df.agg((F.max(ts) + F.expr(f"interval {days} days")).alias(ts), (F.max(order_by) + 1).alias(order_by))
    return df.unionByName(last.select(*[F.col(c) if c in (ts, order_by) else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key of what ``collected`` in update mode."""
    columns = [c for c in df.columns if c not in (*keys, "batch_no")]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_no").alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])
