"""Registered queries that run as streams over the tables laid out as files, with the SQL of their batch twins."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..operators import joins, windows
from ..session import table
from ..sources import readers, sinks
from ..streaming import runner, stateful
from .windowed import ntz


def _stream(s, d, pieces: int = 3):
    return runner.as_stream(table(s, d, "events"), "event_id", pieces)


def t6_stream(s, d):
    """The tumbling counts of t6 as updates, the last of each window."""
    rows = windows.tumble(_stream(s, d).withWatermark("ts", "10 minutes"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.max("value").alias("top")])
    return ntz(runner.latest(runner.collected(rows, "update"), ["window_start", "window_end", "event_type"]))


def n4_append_stream(s, d):
    """Windows sent once, in append mode; a sentinel row closes the last ones."""
    rows = runner.as_stream(runner.with_sentinel(table(s, d, "events"), "ts", "event_id"), "event_id", 3)
    out = windows.tumble(rows.withWatermark("ts", "10 minutes"), "ts", "6 hours", ["user_id"], [F.count("*").alias("n")])
    return ntz(runner.collected(out).where("user_id is not null").drop("batch_no"))


def t17_lateness_stream(s, d):
    """Rows in an order of arrival that isn't theirs in time: windows are sent again as late rows come, as long as the
    delay and the allowed lateness together cover them."""
    e = table(s, d, "events").withColumn("arrival", F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(40)))
    rows = runner.as_stream(e, "arrival", 3).withWatermark("ts", "30 days")
    out = windows.tumble(rows, "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    return ntz(runner.latest(runner.collected(out, "update"), ["window_start", "window_end", "event_type"]))


def t14_stream(s, d):
    rows = windows.cumulate(_stream(s, d), "ts", 7200, 86400, ["event_type"], [F.count("*").alias("n")], delay="1 day")
    return ntz(runner.latest(runner.collected(rows, "update"), ["window_start", "window_end", "event_type"]))


def j4_stream(s, d):
    e = _stream(s, d)
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("c_event_id"), F.col("ts").alias("c_ts")).withWatermark("c_ts", "1 hour")
    b = _stream(s, d).where("event_type = 'purchase'").select(F.col("user_id").alias("p_user"), F.col("event_id").alias("p_event_id"), F.col("ts").alias("p_ts")).withWatermark("p_ts", "1 hour")
    rows = joins.interval_join(a, b, [("user_id", "p_user")], "c_ts", "p_ts", "-5 hours", "10 hours").select("user_id", "c_event_id", "p_event_id")
    return runner.collected(rows).drop("batch_no")


def j12_stream(s, d):
    """A stream enriched by a table that each batch reads anew."""
    dim = table(s, d, "customer")
    rows = joins.enrich(_stream(s, d).select("event_id", "user_id"), [(dim, "user_id", "c_custkey", {"c_mktsegment": "segment"})])
    return runner.collected(rows).drop("batch_no")


def t10_stream(s, d):
    out = stateful.apply(stateful.sharded(_stream(s, d).select("user_id", "event_id", "value"), "user_id"), ["shard"], stateful.CountWindow("user_id", "event_id", "value", 5), "user_id long, window_no long, top double")
    return runner.collected(out).drop("batch_no")


def t26_stream(s, d):
    out = stateful.apply(stateful.sharded(_stream(s, d).select("user_id", "event_id", "event_type"), "user_id"), ["shard"], stateful.PreviousValue("user_id", "event_id", "event_type"), "event_id long, joined string")
    return runner.collected(out).drop("batch_no")


def t32_stream(s, d):
    views = _stream(s, d).where("event_type = 'view'").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    out = stateful.apply(stateful.sharded(views, "user_id"), ["shard"], stateful.DailyFirst("event_id"), "event_id long, user_id long, day string")
    return runner.collected(out).drop("batch_no")


def t24_stream(s, d):
    """As t32, by state that a day of the clock without update removes."""
    views = _stream(s, d).where("event_type = 'view'").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    out = stateful.apply(stateful.sharded(views, "user_id"), ["shard"], stateful.DailyFirst("event_id", 86_400_000), "event_id long, user_id long, day string", time_mode="ProcessingTime")
    return runner.collected(out, idle=False).drop("batch_no")


def t23_stream(s, d):
    rows = _stream(s, d).select("user_id", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = stateful.apply(stateful.sharded(rows, "user_id"), ["shard"], stateful.RunningStats("user_id", "event_id", "event_type", "cents"), "event_id long, n_kind long, top long, mean double")
    return runner.collected(out).drop("batch_no")


def t28_stream(s, d):
    """Windows by state and timers; a sentinel row moves the watermark past the last ones."""
    events = runner.with_sentinel(table(s, d, "events"), "ts", "event_id").fillna(-1, ["user_id"])
    rows = runner.as_stream(events, "event_id", 3).withWatermark("ts", "10 minutes")
    rows = rows.select("user_id", "ts", (F.floor(F.unix_millis("ts") / 21_600_000) * 21_600_000).alias("start_ms"))
    out = stateful.apply(stateful.sharded(rows, "user_id"), ["shard"], stateful.MapWindow("user_id", "start_ms", 21_600_000), "user_id long, window_start_ms long, n long", time_mode="EventTime")
    return runner.collected(out).where("user_id >= 0").drop("batch_no")


def clock_windows(rows, clock: F.Column, keys: list[str], n_rows: int):
    """Tumbling, sliding and session windows by a clock that each row is given when it is processed, with their counts. A
    clock doesn't go back, so it is its own watermark: windows that it has passed are sent once and leave the state. The
    three streams of ``n_rows`` rows run at the same time, as what a batch does beside its tasks leaves cores idle."""
    timed, n = rows.select(*keys, clock.alias("clock")).withWatermark("clock", "0 seconds"), [F.count("*").alias("n")]
    found = {
        "tumbling": windows.tumble(timed, "clock", "10 seconds", keys, n),
        "sliding": windows.hop(timed, "clock", "10 seconds", "5 seconds", keys, n),
        "session": windows.session(timed, "clock", "10 seconds", keys, n),
    }
    with runner.state_for(rows.sparkSession, n_rows), ThreadPoolExecutor(len(found)) as pool:
        sent = list(pool.map(runner.collected, found.values()))
    sent = [df.select(F.lit(kind).alias("kind"), "window_start", "window_end", *keys, "n") for kind, df in zip(found, sent)]
    return sent[0].unionByName(sent[1]).unionByName(sent[2])


def t9_stream(s, d):
    """Windows of a clock that stands in for the machine's, three seconds a row, so that their bounds can be compared; a
    sentinel row an hour later closes the last ones."""
    e = table(s, d, "events").select("event_id", "event_type", F.lit(False).alias("closing"))
    last = e.agg((F.max("event_id") + 1200).alias("event_id")).select("event_id", F.lit(None).cast("string").alias("event_type"), F.lit(True).alias("closing"))
    rows = runner.as_stream(e.unionByName(last), "event_id", 3)
    found = clock_windows(rows, F.timestamp_seconds(1_700_000_000 + F.col("event_id") * 3), ["event_type", "closing"], e.count())
    return ntz(found.where("not closing").drop("closing"))


def t19_stream(s, d):
    """Windows of ten hours that fire each hour of event time and at their end."""
    events = runner.with_sentinel(table(s, d, "events"), "ts", "event_id").fillna(-1, ["user_id"])
    rows = runner.as_stream(events, "event_id", 3).withWatermark("ts", "10 minutes").select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    out = stateful.apply(stateful.sharded(rows, "user_id"), ["shard"], stateful.StepTrigger("user_id", "ms", 36_000_000, 3_600_000), "user_id long, window_start_ms long, fired_ms long, n long", time_mode="EventTime")
    return runner.collected(out).where("user_id >= 0").drop("batch_no")


def t22_stream(s, d):
    """A timer of event time ten seconds after each row."""
    events = runner.with_sentinel(table(s, d, "events"), "ts", "event_id").fillna(-1, ["user_id"])
    rows = runner.as_stream(events, "event_id", 3).withWatermark("ts", "10 minutes").select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    out = stateful.apply(stateful.sharded(rows, "user_id"), ["shard"], stateful.RowTimer("user_id", "ms", 10_000), "user_id long, fired_ms long", time_mode="EventTime")
    return runner.collected(out).where("user_id >= 0").drop("batch_no")


def k2_rolled_files(s, d):
    """Lines of each day in files of 2000 bytes, eight hours, or up to two hours without a row, read back."""
    path = readers.fresh_dir(s)
    lines = table(s, d, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat_ws(",", "event_id", "user_id", "event_type").alias("line"))
    sinks.write_rolled(lines, path, "line", "day", "ts", "event_id", 2000, 8 * 3600, 2 * 3600, "log", ".csv")
    back = s.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("f"), "value")
    name = F.regexp_extract("f", r"([^/]+)/log-(\d+)\.csv$", 1)
    return back.groupBy(name.alias("day"), F.regexp_extract("f", r"/log-(\d+)\.csv$", 1).cast("int").alias("file_no")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min(F.split_part("value", F.lit(","), F.lit(1)).cast("long")).alias("first_id"))


def k6_partition_commit(s, d):
    """Hours of events as JSON folders; an hour is committed an hour after its end."""
    path = readers.fresh_dir(s)
    runner.run_to_end(_stream(s, d), sinks.partition_commit(path, "ts"))
    rows = s.read.option("basePath", path).schema("event_id long").json(f"{path}/dt=*/hour=*/batch_no=*").select("event_id", F.col("_metadata.file_path").alias("f"))
    folder = rows.withColumn("dt", F.regexp_extract("f", "dt=([^/]+)", 1)).withColumn("hour", F.regexp_extract("f", "hour=([^/]+)", 1))
    at = s._jvm.org.apache.hadoop.fs.Path(f"{path}/dt=*/hour=*/_SUCCESS")
    found = at.getFileSystem(s._jsc.hadoopConfiguration()).globStatus(at)
    marks = s.createDataFrame([(str(f.getPath()),) for f in found], "path string").select(F.regexp_extract("path", "dt=([^/]+)", 1).alias("dt"), F.regexp_extract("path", "hour=([^/]+)", 1).alias("hour"), F.lit(True).alias("committed"))
    return folder.groupBy("dt", "hour").agg(F.count("*").alias("n")).join(marks, ["dt", "hour"], "left").withColumn("committed", F.coalesce("committed", F.lit(False)))


def k12_keyed_sink(s, d):
    """A keyed table that every micro-batch updates."""
    path = readers.fresh_dir(s)
    rows = _stream(s, d).select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    last = runner.run_to_end(rows, sinks.keyed_table(path, ["user_id"], "event_id"))
    return sinks.read_keyed(s, path, last).where("not gone").drop("gone")


def k4_columnar_sink(s, d):
    """Parquet by date-and-hour folders, read back."""
    path = readers.fresh_dir(s)
    sinks.write_columnar(sinks.with_bucket(table(s, d, "events"), "ts"), path, ["bucket"])
    return s.read.parquet(path).groupBy(F.col("bucket").cast("string").alias("bucket")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def k3_text_sink(s, d):
    path = readers.fresh_dir(s)
    sinks.write_lines(table(s, d, "orders"), path, ["o_orderkey", "o_custkey", "o_orderstatus"], per_file=5000)
    back = readers.parse_lines(readers.read_lines(s, path), "o_orderkey long, o_custkey long, o_orderstatus string")
    return back


def k8_topic_records(s, d):
    """Each row goes to the topic its kind names; the file twin has a folder for each topic."""
    path = readers.fresh_dir(s)
    rows = sinks.topic_records(table(s, d, "events").withColumn("sink_table", F.concat(F.lit("dwd_"), "event_type")), key="event_id", topic="sink_table", value=["event_id", "user_id"])
    sinks.write_columnar(rows, path, ["topic"])
    return s.read.parquet(path).groupBy("topic").agg(F.count("*").alias("n"), F.max(F.get_json_object("value", "$.event_id").cast("long")).alias("last_id"))


_CUM = "with e as (select *, date_trunc('day', ts) as window_start, unnest(range(epoch_us(ts) // 7200000000 + 1, epoch_us(date_trunc('day', ts)) // 7200000000 + 13)) as k from events) select cast(window_start as timestamp) as window_start, make_timestamp(k * 7200000000) as window_end, event_type, count(*) as n from e group by all"

QUERIES = {
    "t6_tumbling_stream": (t6_stream, "select make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) as window_start, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) + interval 1 hour as window_end, event_type, count(*) as n, max(value) as top from events group by all"),
    "n4_append_stream": (n4_append_stream, "select make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) as window_start, make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) + interval 6 hour as window_end, user_id, count(*) as n from events group by all"),
    "t17_lateness_stream": (t17_lateness_stream, "select cast(date_trunc('day', ts) as timestamp) as window_start, cast(date_trunc('day', ts) as timestamp) + interval 1 day as window_end, event_type, count(*) as n from events group by all"),
    "t14_cumulate_stream": (t14_stream, _CUM),
    "j4_interval_stream": (j4_stream, "select c.user_id, c.event_id as c_event_id, p.event_id as p_event_id from events c join events p on c.user_id = p.user_id and c.event_type = 'click' and p.event_type = 'purchase' and p.ts between c.ts - interval 5 hour and c.ts + interval 10 hour"),
    "j12_lookup_stream": (j12_stream, "select event_id, user_id, c_mktsegment as segment from events left join customer on user_id = c_custkey"),
    "t10_count_window_stream": (t10_stream, "with r as (select *, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as total from events) select user_id, (rn - 1) // 5 + 1 as window_no, max(value) as top from r where (rn - 1) // 5 + 1 <= total // 5 group by 1, 2"),
    "t26_prev_value_stream": (t26_stream, "select event_id, coalesce(lag(event_type) over (partition by user_id order by event_id), 'null') || ':' || upper(event_type) as joined from events"),
    "t32_daily_first_stream": (t32_stream, "select event_id, user_id, strftime(ts, '%Y-%m-%d') as day from events where event_type = 'view' qualify lag(cast(ts as date)) over (partition by user_id order by event_id) is distinct from cast(ts as date)"),
    "t24_ttl_stream": (t24_stream, "select event_id, user_id, strftime(ts, '%Y-%m-%d') as day from events where event_type = 'view' qualify lag(cast(ts as date)) over (partition by user_id order by event_id) is distinct from cast(ts as date)"),
    "t23_state_stream": (t23_stream, "select event_id, count(*) over (partition by user_id, event_type order by event_id) as n_kind, max(cast(round(value * 100) as bigint)) over w as top, cast(sum(cast(round(value * 100) as bigint)) over w as double) / count(*) over w as mean from events window w as (partition by user_id order by event_id)"),
    "t28_map_window_stream": (t28_stream, "select user_id, epoch_ms(ts) // 21600000 * 21600000 as window_start_ms, count(*) as n from events group by all"),
    "t9_clock_windows_stream": (t9_stream, "with e as (select event_type, 1700000000 + event_id * 3 as c from events), w as (select 'tumbling' as kind, c // 10 * 10 as a, c // 10 * 10 + 10 as b, event_type from e union all select 'sliding', k * 5, k * 5 + 10, event_type from (select *, unnest([c // 5 - 1, c // 5]) as k from e) union all select 'session', min(c) over p, max(c) over p + 10, event_type from (select *, sum(new) over (partition by event_type order by c) as s from (select *, case when c - lag(c) over (partition by event_type order by c) < 10 then 0 else 1 end as new from e)) window p as (partition by event_type, s)) select kind, make_timestamp(a * 1000000) as window_start, make_timestamp(b * 1000000) as window_end, event_type, count(*) as n from w group by all"),
    "t19_trigger_stream": (t19_stream, "with e as (select user_id, epoch_us(ts) // 1000 as ms from events), w as (select user_id, ms // 36000000 * 36000000 as start, min(ms) as first from e group by all), f as (select user_id, start, unnest(range(first // 3600000 + 1, start // 3600000 + 11)) * 3600000 as fired from w) select f.user_id, start as window_start_ms, fired as fired_ms, count(*) as n from f join e on e.user_id = f.user_id and ms >= start and ms < fired group by all"),
    "t22_row_timer_stream": (t22_stream, "select distinct user_id, epoch_us(ts) // 1000 + 10000 as fired_ms from events"),
    "k2_rolled_files": (k2_rolled_files, "with l as (select event_id, epoch_us(ts) as us, strftime(ts, '%Y-%m-%d') as day, strlen(event_id || ',' || user_id || ',' || event_type) + 1 as b from events), q as (select *, sum(quiet) over (partition by day order by event_id) as st from (select *, case when us - lag(us) over (partition by day order by event_id) >= 7200000000 then 1 else 0 end as quiet from l)), t as (select *, (us - min(us) over (partition by day, st)) // 28800000000 as turn from q), x as (select *, coalesce(sum(b) over (partition by day, st, turn order by event_id rows between unbounded preceding and 1 preceding), 0) // 2000 as part from t), n as (select *, dense_rank() over (partition by day order by st, turn, part) as file_no from x) select day, cast(file_no as integer) as file_no, count(*) as n, cast(sum(b) as bigint) as bytes, min(event_id) as first_id from n group by all"),
    "k6_partition_commit": (k6_partition_commit, "with h as (select date_trunc('hour', ts) as h, count(*) as n from events group by 1) select strftime(h, '%Y-%m-%d') as dt, strftime(h, '%H') as hour, n, h + interval 2 hour <= (select max(ts) from events) as committed from h"),
    "k3_text_sink": (k3_text_sink, "select o_orderkey, o_custkey, o_orderstatus from orders"),
    "k4_columnar_sink": (k4_columnar_sink, "select strftime(ts, '%Y-%m-%d--%H') as bucket, count(*) as n, max(event_id) as last_id from events group by 1"),
    "k8_topic_records": (k8_topic_records, "select 'dwd_' || event_type as topic, count(*) as n, max(event_id) as last_id from events group by 1"),
    "k12_keyed_sink": (k12_keyed_sink, "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_type <> 'error'"),
}
