"""Sources: files, topics, change streams and database tables, for batch and stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_OWN_DIRS: dict[str, str] = {}


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


def fresh_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rillflow-{uuid.uuid4().hex}"


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return (spark.readStream if streaming else spark.read).text(path)


def watch_files(spark: SparkSession, path: str, fmt: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream. A file that changes later isn't read again."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def parse_lines(df: DataFrame, schema: str, column: str = "value", sep: str = ",") -> DataFrame:
    """Separated text lines as typed rows, fields trimmed; what can't be read is null."""
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}
    return df.select(F.from_csv(column, schema, options).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", quote: str = "|", null: str = "\\N", comment: str = "#") -> DataFrame:
    return spark.read.schema(schema).options(sep=sep, quote=quote, nullValue=null, comment=comment, mode="PERMISSIVE").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table, read once; with a column and (lower, upper, partitions) by several tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return reader.load()


def topic_options(servers: str, topic: str, start: str | dict | int = "latest", end: str | dict | None = None, headers: bool = False) -> dict[str, str]:
    """Options of a topic source. ``start``: earliest, latest, a timestamp in ms, or offsets by partition; ``end`` bounds a
    batch read."""
    import json

    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": str(headers).lower()}
    if isinstance(start, int):
        out["startingTimestamp"] = str(start)
    else:
        out["startingOffsets"] = json.dumps({topic: start}) if isinstance(start, dict) else start
    if end is not None:
        out["endingOffsets"] = json.dumps({topic: end}) if isinstance(end, dict) else end
    return out


def topic_rows(df: DataFrame, key_schema: str | None, value_schema: str) -> DataFrame:
    """Typed rows of a topic frame with its offset, record time and headers; values that can't be read are null."""
    fields = [F.from_json(F.col("value").cast("string"), value_schema).alias("v")]
    if key_schema:
        fields.append(F.from_json(F.col("key").cast("string"), key_schema).alias("k"))
    extra = [c for c in ("topic", "partition", "offset", "timestamp", "headers") if c in df.columns]
    out = df.select(*extra, *fields)
    if "headers" in extra:
        texts = F.transform_values(F.map_from_entries("headers"), lambda _, v: v.cast("string"))
        out = out.withColumn("headers", texts)
    return out.select(*extra, *(["k.*"] if key_schema else []), "v.*")


def changes_with_snapshot(snapshot: DataFrame | None, changes: DataFrame) -> DataFrame:
    """A change stream that begins with a snapshot as inserts (initial), or without one (latest)."""
    return changes if snapshot is None else snapshot.unionByName(changes, allowMissingColumns=True)
