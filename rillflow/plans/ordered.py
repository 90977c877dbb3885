"""Registered queries: changelogs and operators on each key's rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggs, changelog, sequences, windows
from ..session import table


def _events(s, d) -> DataFrame:
    return table(s, d, "events")


def n1_union(s, d):
    e = _events(s, d).select("user_id", "event_type")
    every = e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'")).unionByName(e.where("user_id < 50"))
    return every.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def n2_apply_changelog(s, d):
    changes = _events(s, d).select("user_id", "event_id", "event_type", "value")
    return changelog.apply_changelog(changes, ["user_id"], "event_id", F.col("event_type") == "error")


def n3_emit_changelog(s, d):
    out = changelog.emit_changelog(_events(s, d).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.max("value"), "top")
    return out.select("user_id", "event_id", "op", "top")


def t25_running_concat(s, d):
    some = _events(s, d).withColumn("c", F.substring("event_type", 1, 1))
    return sequences.running_concat(some, ["user_id"], ["event_id"], "c").select("event_id", F.length("joined").alias("n"), F.md5("joined").alias("digest"))


def t26_prev_value(s, d):
    return sequences.prev_value(_events(s, d), ["user_id"], ["event_id"], "event_type").select("event_id", "joined")


def t27_periodic_count(s, d):
    return sequences.periodic_count(_events(s, d), "user_id", "ts", "event_id", 6 * 3600)


def t29_every_fifth(s, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    out = aggs.every_n(_events(s, d).withColumn("ms", ms), ["user_id"], ["event_id"], 5, {"sum_ms": F.sum("ms"), "n": F.count("*")})
    return out.select("event_id", "user_id", F.expr("sum_ms div n").alias("avg_ms"), "n")


def t30_patterns(s, d):
    pairs = _events(s, d).where("event_type in ('signup', 'error')").select(F.lit("click").alias("first"), F.col("event_type").alias("second"), "event_id")
    patterns = pairs.groupBy("first", "second").agg(F.max("event_id").alias("seq"))
    return sequences.pattern_pair(_events(s, d), "user_id", ["event_id"], "event_type", patterns, last_wins="seq").select("event_id", "before", "event_type")


def t31_repair_is_new(s, d):
    e = _events(s, d).withColumn("is_new", (F.col("event_id") % 3 == 0).cast("int"))
    return sequences.repair_is_new(e, "user_id", ["event_id"]).select("event_id", "is_new")


def t32_daily_first(s, d):
    return sequences.daily_first(_events(s, d), "user_id", "ts", ["event_id"], F.col("event_type") == "view").select("event_id", "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def t33_bounce(s, d):
    return sequences.bounce(_events(s, d), "user_id", "ts", ["event_id"], F.col("event_type") == "view", 7200).select("event_id", "user_id")


def t34_consecutive(s, d):
    return sequences.consecutive(_events(s, d), "user_id", "ts", ["event_id"], F.col("value") > 10, 3, 86400).select("event_id", "user_id")


def t15_group_window(s, d):
    """The older window syntax: only the end is shown."""
    per = _events(s, d).groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return per.select(F.col("w.end").alias("window_end"), "user_id", "n")


def c15_watermark(s, d):
    """The watermark each row sees: the greatest time of all rows so far, less the delay; one for all keys."""
    seen = windows.high_water(_events(s, d), F.col("ts"), "event_id", "seen")
    return seen.select("event_id", (F.col("seen") - F.expr("interval 10 minutes")).alias("watermark"))


def u5_whole_rows(s, d):
    return aggs.top_n(table(s, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 2, "rank").select("c_nationkey", "c_custkey", "c_name", "rank")


QUERIES = {
    "n1_union": (n1_union, "select user_id, event_type, count(*) as n from (select user_id, event_type from events where event_type = 'click' union all select user_id, event_type from events where event_type = 'view' union all select user_id, event_type from events where user_id < 50) group by all"),
    "n2_apply_changelog": (n2_apply_changelog, "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_type <> 'error'"),
    "n3_emit_changelog": (n3_emit_changelog, "with r as (select *, max(value) over w as v, row_number() over (partition by user_id order by event_id) as n from events window w as (partition by user_id order by event_id rows unbounded preceding)), p as (select *, lag(v) over (partition by user_id order by event_id) as old from r) select user_id, event_id, '+I' as op, v as top from p where n = 1 union all select user_id, event_id, '-U', old from p where n > 1 union all select user_id, event_id, '+U', v from p where n > 1"),
    "t15_group_window": (t15_group_window, "select make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) + interval 1 hour as window_end, user_id, count(*) as n from events group by all"),
    "t25_running_concat": (t25_running_concat, "select event_id, cast(length(j) as integer) as n, md5(j) as digest from (select event_id, string_agg(substr(event_type, 1, 1), '' order by event_id) over (partition by user_id order by event_id rows unbounded preceding) as j from events)"),
    "t26_prev_value": (t26_prev_value, "select event_id, coalesce(lag(event_type) over (partition by user_id order by event_id), 'null') || ':' || upper(event_type) as joined from events"),
    "t27_periodic_count": (t27_periodic_count, "with recursive e as (select user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by event_id) as rn from events), r as (select user_id, us, rn, us + 21600000000 as due, true as sets from e where rn = 1 union all select e.user_id, e.us, e.rn, case when e.us >= r.due then e.us + 21600000000 else r.due end, e.us >= r.due from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select user_id, due as fired_us, max(rn) as n from r group by user_id, due"),
    "t29_every_fifth": (t29_every_fifth, "with r as (select event_id, user_id, sum(epoch_us(ts) // 1000) over w as s, count(*) over w as n from events window w as (partition by user_id order by event_id rows unbounded preceding)) select event_id, user_id, cast(s // n as bigint) as avg_ms, n from r where n % 5 = 0"),
    "t30_patterns": (t30_patterns, "with l as (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) select event_id, before, event_type from l where before = 'click' and event_type = (select event_type from events where event_type in ('signup', 'error') order by event_id desc limit 1)"),
    "t31_repair_is_new": (t31_repair_is_new, "with e as (select event_id, user_id, event_id % 3 = 0 as new from events) select event_id, case when new and sum(case when new then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) = 1 then 1 else 0 end as is_new from e"),
    "t32_daily_first": (t32_daily_first, "select event_id, user_id, strftime(ts, '%Y-%m-%d') as day from events where event_type = 'view' qualify lag(cast(ts as date)) over (partition by user_id order by event_id) is distinct from cast(ts as date)"),
    "t33_bounce": (t33_bounce, "with e as (select *, lead(event_type) over w as nt, lead(ts) over w as ns from events window w as (partition by user_id order by event_id)) select event_id, user_id from e where event_type = 'view' and (ns is null or nt = 'view' or ns - ts >= interval 2 hour)"),
    "t34_consecutive": (t34_consecutive, "with e as (select *, lead(value, 1) over w as v1, lead(value, 2) over w as v2, lead(ts, 2) over w as t2 from events window w as (partition by user_id order by event_id)) select event_id, user_id from e where value > 10 and v1 > 10 and v2 > 10 and t2 - ts < interval 1 day"),
    "c15_watermark": (c15_watermark, "select event_id, max(ts) over (order by event_id rows unbounded preceding) - interval 10 minute as watermark from events"),
    "u5_whole_rows": (u5_whole_rows, "select c_nationkey, c_custkey, c_name, cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as integer) as rank from customer qualify rank <= 2"),
}
