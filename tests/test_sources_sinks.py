from pyspark.sql import functions as F

from rillflow.operators import project
from rillflow.sources import readers, sinks
from rillflow.streaming import runner, stateful


def test_csv_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# comment\n1,|zs,x|,\\N\n2,bb,7\nbad,cc,x\n")
    rows = readers.read_csv(spark, str(tmp_path), "id int, name string, n int").orderBy("name").collect()
    assert [tuple(r) for r in rows] == [(2, "bb", 7), (None, "cc", None), (1, "zs,x", None)]


def test_topic_options_and_rows(spark):
    options = readers.topic_options("h:9092", "t", {"0": 5}, {"0": 9}, headers=True)
    assert options["startingOffsets"] == '{"t": {"0": 5}}' and options["endingOffsets"] == '{"t": {"0": 9}}' and options["includeHeaders"] == "true"
    assert readers.topic_options("h", "t", 1000)["startingTimestamp"] == "1000"
    df = spark.sql("select encode('{\"k\":1}', 'utf-8') as key, encode('{\"v\":2}', 'utf-8') as value, 7L as offset, array(struct('h' as key, encode('x', 'utf-8') as value)) as headers")
    row = readers.topic_rows(df, "k int", "v int").first()
    assert (row.offset, row.headers, row.k, row.v) == (7, {"h": "x"}, 1, 2)


def test_partition_commit_closes_past_hours(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1 as n union all select timestamp'2024-01-01 03:00:00', 2")
    sinks.partition_commit(str(tmp_path / "t"), "ts")(rows, 0)
    assert (tmp_path / "t/dt=2024-01-01/hour=00/_SUCCESS").exists()
    assert not (tmp_path / "t/dt=2024-01-01/hour=03/_SUCCESS").exists()


def test_partition_commit_is_repeatable(spark, tmp_path):
    path = tmp_path / "t"
    sink = sinks.partition_commit(str(path), "ts")
    frame = lambda *at: spark.createDataFrame([(t, k) for k, t in enumerate(at)], "ts string, n int").withColumn("ts", F.to_timestamp("ts"))
    closed = lambda: sorted(f.parent.name for f in path.glob("dt=*/hour=*/_SUCCESS"))
    sink(frame("2024-01-01 00:10:00", None), 0)
    assert closed() == []
    for _ in range(2):
        sink(frame("2024-01-01 02:00:00", "2024-01-01 02:30:00"), 1)
    assert closed() == ["hour=00"]
    sink(frame("2024-01-01 01:59:00"), 2)  # late: an hour that isn't past the delay yet
    sink(frame("2024-01-01 04:00:00"), 3)
    assert closed() == ["hour=00", "hour=01", "hour=02"]
    sink(frame(), 4)
    assert spark.read.json(str(path)).count() == 6


def test_keyed_table_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "k")
    sink = sinks.keyed_table(path, ["id"], "seq")
    frame = lambda rows: spark.createDataFrame(rows, "id int, seq int, v string, gone boolean")
    sink(frame([(1, 1, "a", False), (2, 1, "b", False)]), 0)
    for _ in range(2):
        sink(frame([(1, 2, "c", False), (2, 2, None, True)]), 1)
    assert [tuple(r)[:3] for r in sinks.read_keyed(spark, path, 1, "gone").collect()] == [(1, 2, "c")]
    sink(frame([(2, 1, "old", False)]), 2)  # older than the removal
    assert [tuple(r)[:3] for r in sinks.read_keyed(spark, path, 2, "gone").collect()] == [(1, 2, "c")]


def test_ledger_and_chunks(spark, tmp_path):
    sink = sinks.append_ledger(str(tmp_path / "l"))
    for _ in range(2):
        sink(spark.range(5), 3)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 5
    out = str(tmp_path / "chunks")

    def write(rows):
        with open(out, "a") as f:
            f.write(f"{len(rows)}\n")

    sinks.in_chunks(write, 10)(spark.range(0, 25, 1, 1), 0)
    assert open(out).read().split() == ["10", "10", "5"]
    assert sinks.upsert_sql("t", ["id", "v"], ["id"], "s").startswith("MERGE INTO t t USING s s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v")


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.range(0, 10).withColumn("k", F.col("id") % 2).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long, k long").parquet(src).groupBy("k").agg(F.count("*").alias("n"))
    sink = sinks.append_ledger(out)
    runner.run_to_end(stream(), sink, "update", mark)
    spark.range(10, 16).withColumn("k", F.col("id") % 2).write.mode("append").parquet(src)
    runner.run_to_end(stream(), sink, "update", mark)
    rows = spark.read.parquet(out).groupBy("k").agg(F.max_by("n", "batch").alias("n")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(0, 8), (1, 8)]


def test_event_time_timer_counts(spark, tmp_path):
    rows = spark.sql("select id % 2 as user_id, timestamp_seconds(id * 60) as ts, id as event_id from range(60)")
    df = runner.as_stream(rows, "event_id", 3, str(tmp_path / "s")).withWatermark("ts", "0 seconds")
    out = stateful.apply(df, ["user_id"], stateful.DueCount(600_000, "ts"), "user_id long, n long, due_ms long", time_mode="EventTime")
    fired = runner.collected(out).collect()
    assert fired and {r.user_id for r in fired} == {0, 1}


def test_clock_timer_and_state_that_expires(spark, tmp_path):
    rows = spark.sql("select id % 2 as user_id, 'x' as day, id as event_id from range(60)")
    waits = runner.as_stream(rows, "event_id", 3, str(tmp_path / "a"))
    out = stateful.apply(waits, ["user_id"], stateful.DueCount(0), "user_id long, n long, due_ms long", time_mode="ProcessingTime")
    fired = runner.collected(out, idle=False).collect()
    assert {r.user_id for r in fired} == {0, 1} and all(1 <= r.n <= 30 for r in fired)
    for ttl, want in ((None, 2), (1, 6)):  # a state that is gone before the next batch makes each batch's first row a first one
        df = runner.as_stream(rows, "event_id", 3, str(tmp_path / f"b{ttl}"))
        out = stateful.apply(df, ["user_id"], stateful.DailyFirst("event_id", ttl), "event_id long, user_id long, day string", time_mode="ProcessingTime" if ttl else "None")
        assert runner.collected(out, idle=False).count() == want


def test_refire_by_hand(spark):
    from rillflow.operators import windows

    rows = spark.createDataFrame([(1, 5), (2, 8), (3, 25), (4, 9), (5, 45), (6, 7), (7, None)], "arrival long, sec int").withColumn("ts", F.timestamp_seconds("sec"))
    got = windows.refire(rows.withColumn("k", F.lit("a")), ["k"], "ts", "arrival", 10, 10, 20).select(F.unix_seconds("window_end"), "fired", "arrived", "n").collect()
    # The window to 10 ends on time with rows 1 and 2; 4 comes after the mark of 15; 6 comes at a mark of 35, past 10 + 20.
    assert sorted(map(tuple, got), key=str) == sorted([(10, "on time", None, 2), (10, "late", 4, 3), (30, "on time", None, 1), (50, "on time", None, 1)], key=str)


def test_create_table_from_config(spark):
    ddl = project.create_table_sql("rill_dim", "id,name", None, None)
    assert ddl == "CREATE TABLE IF NOT EXISTS rill_dim (id STRING NOT NULL, name STRING) USING parquet"
    assert project.sink_schema("id, name").fieldNames() == ["id", "name"]


def test_fixed_examples(spark):
    from rillflow.operators import aggs, sequences

    tags = spark.createDataFrame([(1, "zs", ["stu", "child"]), (2, "bb", ["miss"])], "id int, name string, tags array<string>")
    assert [tuple(r) for r in tags.select("id", "name", F.explode("tags")).collect()] == [(1, "zs", "stu"), (1, "zs", "child"), (2, "bb", "miss")]
    letters = spark.createDataFrame(list(enumerate("ababca")), "o int, k string")
    got = sequences.running_concat(letters, ["k"], ["o"], "k").orderBy("o").collect()
    assert [r.joined for r in got] == ["a", "b", "aa", "bb", "c", "aaa"]
    ages = spark.createDataFrame([("male", 20), ("male", 50), ("female", 30), ("female", 40)], "g string, age int")
    assert {tuple(r) for r in ages.groupBy("g").agg(aggs.weighted_average("age", "1").alias("a")).collect()} == {("male", 35), ("female", 35)}
