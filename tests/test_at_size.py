"""Steps whose work once went file by file or key by key."""

import datetime as dt
import os

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from rillflow.operators import project
from rillflow.plans import streams, warehouse
from rillflow.sources import sinks
from rillflow.streaming import runner, stateful

START = dt.datetime(2024, 1, 1)


def test_rolled_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a folder and a commit for each file")

    monkeypatch.setattr(DataFrameWriter, "text", refused)
    rows = [(i, START + dt.timedelta(seconds=i), ("a", "b:c", None)[i % 3], f"line {i}" if i % 10 else None) for i in range(60)]
    path = str(tmp_path / "out")
    sinks.write_rolled(spark.createDataFrame(rows, "i long, ts timestamp, k string, v string"), path, "v", "k", "ts", "i", 50, 3600, 3600, "log", ".csv")
    assert sorted(os.listdir(path)) == ["__HIVE_DEFAULT_PARTITION__", "a", "b%3Ac"]
    for folder, k in (("a", 0), ("b%3Ac", 1), ("__HIVE_DEFAULT_PARTITION__", 2)):
        names = [f"log-{n + 1}.csv" for n in range(len(os.listdir(f"{path}/{folder}")))]
        assert len(names) > 2
        text = "".join(open(f"{path}/{folder}/{name}").read() for name in names)
        assert text == "".join(f"{v or ''}\n" for i, _, _, v in rows if i % 3 == k)


def test_keys_of_a_shard_share_a_call(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = [(i % 50 if i % 7 else None, i, None if i % 11 == 0 else "abc"[i % 3], i / 4) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, kind string, value double")

    class Counted(stateful.PreviousValue):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    stream = stateful.sharded(runner.as_stream(df, "event_id", 3), "user_id", 2)
    out = runner.collected(stateful.apply(stream, ["shard"], Counted("user_id", "event_id", "kind"), "event_id long, joined string"))
    last, want = {}, {}
    for k, i, kind, _ in rows:
        want[i] = f"{last.get(k) or 'null'}:{kind.upper()}" if kind else None
        last[k] = kind
    assert {r.event_id: r.joined for r in out.collect()} == want
    assert calls.value <= 2 * 4


def test_order_details_of_ten_years(spark, sf_dir):
    found = warehouse.w4_order_wide(spark, sf_dir).count()
    o, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    days = F.datediff("l_shipdate", "o_orderdate")
    assert found == o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).where(days.between(-5, 3650)).count()


def test_windows_of_a_clock_leave_the_state(spark, sf_dir, monkeypatch):
    modes, own = [], runner.collected
    monkeypatch.setattr(runner, "collected", lambda df, mode="append", idle=True: modes.append(mode) or own(df, mode, idle))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert streams.t9_stream(spark, sf_dir).where("kind = 'tumbling'").agg(F.sum("n")).first()[0] == events.count()
    assert set(modes) == {"append"}  # with a watermark: what was sent is forgotten


def test_state_of_clock_windows_has_parts_for_its_rows(spark, sf_dir, monkeypatch):
    """A store of state costs each batch far more than a row does, so a stream hasn't as many as a shuffle has partitions."""
    paths, own = [], runner.fresh_dir
    monkeypatch.setattr(runner, "fresh_dir", lambda s: paths.append(own(s)) or paths[-1])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert streams.t9_stream(spark, sf_dir).count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    stores = [len([n for n in os.listdir(f"{p}/state/0") if n.isdigit()]) for p in paths if os.path.isdir(f"{p}/state/0")]
    assert stores == [spark.sparkContext.defaultParallelism] * 3
    with runner.state_for(spark, 100 * runner.STATE_ROWS + 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "101"


def test_changes_stay_where_they_are_read(spark):
    changes = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "t").otherwise("u").alias("table_name"), F.when(F.col("id") % 3 == 0, "update").otherwise("insert").alias("op"), F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("b"), F.lit("x")).alias("after"))
    config = spark.createDataFrame([("t", "insert", "kafka", "out", "a")], "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # neither side's measured size decides
    try:
        out = project.route_by_config(changes, config)
        rows = {(r.id, tuple(r.after)) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows == {(i, ("a",)) for i in range(100) if i % 2 == 0 and i % 3}


def test_product_windows_meet_in_parts(spark, sf_dir, monkeypatch):
    before = warehouse.w9_product_windows(spark, sf_dir).collect()
    monkeypatch.setattr(warehouse, "PART_ROWS", 100)
    out = warehouse.w9_product_windows(spark, sf_dir)
    rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem"))
    assert out.rdd.getNumPartitions() >= rows // 100  # as many as the rows ask for
    assert sorted(out.collect(), key=str) == sorted(before, key=str)
    below = out._jdf.queryExecution().sparkPlan().toString()
    dealt = [at for at, text in enumerate(below.splitlines()) if "Exchange" in text]
    grouped = [at for at, text in enumerate(below.splitlines()) if "Aggregate" in text]
    assert len(dealt) == 2 and max(grouped) < max(dealt)  # nothing is grouped where it is read
