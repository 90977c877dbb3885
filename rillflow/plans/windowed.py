"""Registered queries: windows, joins, ranking and distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggs, changelog, joins, windows
from ..session import table
from ..sources import readers


def _events(s, d, *kinds: str) -> DataFrame:
    e = table(s, d, "events")
    return e.where(F.col("event_type").isin(*kinds)) if kinds else e


def _side(s, d, kind: str, tag: str) -> DataFrame:
    """One kind of event with its columns tagged, as a side of a join."""
    return _events(s, d, kind).select("user_id", *[F.col(c).alias(f"{tag}_{c}") for c in ("event_id", "ts", "value")])


def ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def bucket(c: str, seconds: int) -> str:
    """SQL of the start of the epoch-aligned window of so many seconds."""
    return f"make_timestamp(epoch_us({c}) // {seconds * 1_000_000} * {seconds * 1_000_000})"


def t6_tumble(s, d):
    return windows.tumble(_events(s, d), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.max("value").alias("top")])


def t7_hop(s, d):
    return windows.hop(_events(s, d), "ts", "6 hours", "2 hours", ["user_id"], [F.count("*").alias("n"), F.max("value").alias("top"), F.max_by("event_type", F.struct("value", "event_id")).alias("kind")])


def t8_session(s, d):
    return windows.session(_events(s, d), "ts", "2 hours", ["user_id"], [F.count("*").alias("n")])


def t10_count_window(s, d):
    rows = windows.count_window(_events(s, d), ["user_id"], ["event_id"], 5)
    return rows.groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("event_id").alias("first_id"))


def t11_sliding_count(s, d):
    rows = windows.count_window(_events(s, d), ["user_id"], ["event_id"], 5, 2)
    return rows.groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("event_id").alias("first_id"))


def t12_window_all(s, d):
    return windows.tumble(_events(s, d), "ts", "1 day", [], [F.count("*").alias("n"), F.count_distinct("user_id").alias("users")])


def t14_cumulate(s, d):
    return ntz(windows.cumulate(_events(s, d), "ts", 7200, 86400, ["event_type"], [F.count("*").alias("n"), F.count_distinct("user_id").alias("users")]))


def t17_refire(s, d):
    """Hour windows that wait an hour and take late rows for two more; rows arrive up to 97 places late."""
    e = _events(s, d).withColumn("arrival", (F.col("event_id") + F.col("event_id") * 7919 % 97) * 1_000_000 + F.col("event_id"))
    return ntz(windows.refire(e, ["event_type"], "ts", "arrival", 3600, 3600, 7200))


def t18_late_split(s, d):
    # Arrival order by a hash within the hour, so that some rows come late.
    e = _events(s, d).withColumn("arrival", F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(40)))
    e = e.withColumn("arrival", F.col("arrival") * 1_000_000 + F.col("event_id"))
    main, late = windows.late_split(e, "ts", "arrival", 3600, 1800, 3600)
    return main.select("event_id", F.lit("main").alias("side")).unionByName(late.select("event_id", F.lit("late").alias("side")))


def t19_early_fire(s, d):
    return ntz(windows.cumulate(_events(s, d), "ts", 3600, 21600, ["user_id"], [F.count("*").alias("n")])).where(F.col("window_end") < F.col("window_start") + F.expr("interval 6 hours"))


def t20_marker(s, d):
    return windows.marker_trigger(_events(s, d), ["user_id"], "ts", "event_id", "1 day", F.col("event_type") == "error")


def t16_full_window(s, d):
    """What a function of the whole window gives, from its ends: no window is held as a list."""
    order = F.struct("ts", "event_id")
    per = _events(s, d).groupBy(F.window("ts", "12 hours").alias("w"), "user_id")
    per = per.agg(F.count("*").cast("int").alias("n"), F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"))
    return per.select(F.col("w.start").alias("window_start"), "user_id", "n", "first_id", "last_id")


def j1_window_join(s, d):
    return joins.window_join(_side(s, d, "click", "c"), _side(s, d, "purchase", "p"), ["user_id"], "c_ts", "p_ts", "6 hours").select("user_id", "window_start", "c_event_id", "p_event_id")


def _windowed(how: str):
    def run(s, d):
        out = joins.window_join(_side(s, d, "click", "c"), _side(s, d, "purchase", "p"), ["user_id"], "c_ts", "p_ts", "6 hours", how)
        own = ["c_event_id"] if "left_" in how else ["c_event_id", "p_event_id"]
        return out.select("user_id", "window_start", *own)

    return run


def _windowed_sql(how: str) -> str:
    c, p = (f"(select user_id, event_id, {bucket('ts', 21600)} as w from events where event_type = '{k}')" for k in ("click", "purchase"))
    if how in ("semi", "anti"):
        return f"select c.user_id, c.w as window_start, c.event_id as c_event_id from {c} c {how} join {p} p on c.user_id = p.user_id and c.w = p.w"
    return f"select coalesce(c.user_id, p.user_id) as user_id, coalesce(c.w, p.w) as window_start, c.event_id as c_event_id, p.event_id as p_event_id from {c} c {how} join {p} p on c.user_id = p.user_id and c.w = p.w"


def j2_cogroup(s, d):
    out = joins.cogroup_lists(_side(s, d, "click", "c"), _side(s, d, "purchase", "p"), ["user_id"], "c_ts", "p_ts", "6 hours", "c_event_id", "p_event_id")
    return out.select("user_id", "window_start", F.size("left_rows").alias("n_left"), F.size("right_rows").alias("n_right"), F.array_join(F.col("left_rows").cast("array<string>"), ",").alias("left_ids"))


def j4_interval(s, d):
    a = _side(s, d, "click", "c")
    b = _side(s, d, "purchase", "p").withColumnRenamed("user_id", "p_user")
    return joins.interval_join(a, b, [("user_id", "p_user")], "c_ts", "p_ts", "-5 hours", "10 hours").select("user_id", "c_event_id", "p_event_id")


def j5_interval_cells(s, d):
    a = _events(s, d, "view").select(F.lit(1).alias("k"), F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = _events(s, d, "error").select(F.lit(1).alias("k2"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    return joins.interval_join(a, b, [("k", "k2")], "a_ts", "b_ts", "0 seconds", "120 seconds", cell_s=120).select("a_id", "b_id")


def j10_left_ttl(s, d):
    a = _side(s, d, "click", "c")
    b = _side(s, d, "purchase", "p").withColumnRenamed("user_id", "p_user")
    return joins.interval_join(a, b, [("user_id", "p_user")], "c_ts", "p_ts", "-1 hours", "1 hours", how="left").select("user_id", "c_event_id", "p_event_id")


def j11_full_history(s, d):
    a, b = table(s, d, "customer"), table(s, d, "supplier")
    # Both sides are counted before they meet: the pairs of a nation are the product, and aren't made.
    left = a.groupBy("c_nationkey").agg(F.count("*").alias("n_left"))
    right = b.groupBy("s_nationkey").agg(F.count("*").alias("n_right"), F.max("s_acctbal").alias("top"))
    return left.join(right, left["c_nationkey"] == right["s_nationkey"]).select("c_nationkey", (F.col("n_left") * F.col("n_right")).alias("pairs"), "top")


def j12_lookup(s, d):
    dims = [(table(s, d, "customer"), "o_custkey", "c_custkey", {"c_mktsegment": "segment"})]
    return joins.enrich(table(s, d, "orders"), dims).select("o_orderkey", "segment")


def j13_asof(s, d):
    versions = _events(s, d, "signup").select("user_id", F.col("ts").alias("v_ts"), F.col("value").alias("rate"), F.col("event_id").alias("version"))
    return joins.asof_join(_events(s, d, "purchase").select("user_id", "event_id", "ts"), versions, ["user_id"], "ts", "v_ts", ["rate", "version"]).select("event_id", "rate", "version")


def j15_enrich_split(s, d):
    dim = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    hit, miss = joins.enrich_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), dim, "o_custkey")
    return hit.select("o_orderkey", "c_mktsegment", F.lit("hit").alias("side")).unionByName(miss.select("o_orderkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit("miss").alias("side")))


def j16_enrich_chain(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    dims = [
        (table(s, d, "part"), "l_partkey", "p_partkey", {"p_brand": "brand"}),
        (table(s, d, "supplier"), "l_suppkey", "s_suppkey", {"s_nationkey": "nation"}),
        (table(s, d, "nation"), "nation", "n_nationkey", {"n_name": "nation_name", "n_regionkey": "region"}),
        (table(s, d, "region"), "region", "r_regionkey", {"r_name": "region_name"}),
    ]
    return joins.enrich(line, dims).groupBy("brand", "nation_name", "region_name").agg(F.count("*").alias("n"))


def j18_reconcile(s, d):
    a = _events(s, d, "purchase").select(F.col("user_id").alias("k"), "ts")
    b = _events(s, d, "click").select(F.col("user_id").alias("k"), "ts")
    return joins.reconcile(a, b, "k", "ts", "ts", 3600).groupBy("key", "status").agg(F.count("*").alias("n"))


def j19_unnest(s, d):
    return table(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))


def j22_range_lookup(s, d):
    rules = table(s, d, "nation").select((F.col("n_nationkey") * 40_000).cast("long").alias("low"), (F.col("n_nationkey") * 40_000 + 30_000).cast("long").alias("high"), "n_name")
    o = table(s, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price"))
    return joins.range_lookup(o, rules, "price", "low", "high", 10_000, {"n_name": F.lit("-1")}, levels=1).select("o_orderkey", "n_name")


def k13_retractions(s, d):
    """Orders joined to the lines sent back: a line may come before its order, so some orders are first sent alone."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 10 + 3).alias("o_seq"))
    line = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_seq"))
    return changelog.outer_join_changelog(o, line, "o_orderkey", "o_seq", "l_seq").select("o_orderkey", "l_linenumber", "op", "seq")


def k13_keyed_table(s, d):
    """The table that the retractions leave under the key of order and line; lines of one number are one row of it."""
    return changelog.apply_changelog(k13_retractions(s, d), ["o_orderkey", "l_linenumber"], "seq", F.col("op") == "-D").select("o_orderkey", "l_linenumber")


def r1_global_top(s, d):
    per = _events(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return aggs.global_top_n(per, [F.desc("n"), F.asc("user_id")], 2)


def r2_window_top(s, d):
    return aggs.window_top_n(_events(s, d), "ts", "1 day", ["user_id"], [F.count("*").alias("n"), F.max("value").alias("top")], [F.desc("n"), F.desc("top"), F.asc("user_id")], 2).drop("window_end")


def r2_stream_form(s, d):
    per = windows.tumble(_events(s, d), "ts", "1 day", ["user_id"], [F.count("*").alias("n"), F.max("value").alias("top")])
    return aggs.struct_top_n(per, ["window_start"], "n", ["top", "user_id"], 2).select("window_start", "rn", "n", "top")


def r3_raw_top(s, d):
    e = _events(s, d).withColumn("window_start", F.window("ts", "6 hours")["start"])
    return aggs.top_n(e, ["window_start"], [F.desc("value"), F.asc("event_id")], 2).select("window_start", "event_id", "value", "rn")


def r4_top_per_key(s, d):
    return aggs.top_n(table(s, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_mktsegment", "c_custkey", "c_acctbal", "rn")


def r5_over_rows(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 0)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _events(s, d).select("event_id", F.sum(ms).over(w).alias("sum_ms"), F.count("*").over(w).alias("n"))


def r7_hop_top(s, d):
    return aggs.window_top_n(_events(s, d), "ts", "12 hours", ["user_id"], [F.count("*").alias("n")], [F.desc("n"), F.asc("user_id")], 2, slide="6 hours").drop("window_end")


def r8_top_average(s, d):
    mean = (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean")
    return aggs.window_top_n(_events(s, d).withColumn("page", F.col("user_id") % 4), "ts", "12 hours", ["page", "event_type"], [mean], [F.desc("mean"), F.asc("event_type")], 2, slide="6 hours", within=("page",)).drop("window_end")


def r9_top_rows(s, d):
    e = _events(s, d).withColumn("w", F.window("ts", "1 day")).select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_id", "value")
    return aggs.top_n(e, ["user_id", "window_start"], [F.desc("value"), F.asc("event_id")], 2)


def r10_window_sort(s, d):
    e = _events(s, d).withColumn("w", F.window("ts", "1 day"))
    # Two rows of a window are kept, not its whole list; the count is partial before the shuffle.
    two = e.withColumn("rn", F.row_number().over(Window.partitionBy("w").orderBy(F.desc_nulls_last("value")))).where("rn <= 2")
    best = two.groupBy("w").agg(F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("second"))
    counts = e.groupBy("w").agg(F.count("value").cast("int").alias("n"))
    return counts.join(best, "w").select(F.col("w.start").alias("window_start"), "first", "second", "n")


def d1_shuffle(s, d):
    spread = _events(s, d).repartition(6).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return spread.agg(F.count("*").alias("partitions"), F.sum("n").alias("n"))


def d2_rescale(s, d):
    placed = _events(s, d).repartition(8).coalesce(2).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return placed.agg(F.count("*").alias("partitions"), F.sum("n").alias("n"))


def a11_set_uv(s, d):
    """Distinct users of a window as the size of a set, the form a stream allows."""
    return windows.tumble(_events(s, d), "ts", "1 day", ["event_type"], [F.size(F.collect_set("user_id")).alias("uv")])


def s11_snapshot_changes(s, d):
    """A snapshot as inserts, then changes: the table they leave."""
    o = table(s, d, "orders").select((F.col("o_orderkey") % 900).alias("id"), "o_orderstatus", F.col("o_orderkey").alias("seq"))
    snapshot = o.where("seq < 900").withColumn("op", F.lit("insert"))
    changes = o.where("seq >= 900").withColumn("op", F.when(F.col("seq") % 5 == 0, "delete").otherwise("update"))
    return changelog.apply_changelog(readers.changes_with_snapshot(snapshot, changes), ["id"], "seq", F.col("op") == "delete").drop("op")


def d4_custom(s, d):
    """Rows of even and odd keys each in one partition of its own."""
    placed = _events(s, d).repartitionById(2, (F.col("user_id") % 2).cast("int")).withColumn("p", F.spark_partition_id())
    return placed.groupBy((F.col("user_id") % 2).alias("parity")).agg(F.count_distinct("p").alias("partitions"), F.count("*").alias("n"))


def d5_key_by(s, d):
    placed = _events(s, d).repartition("user_id").withColumn("p", F.spark_partition_id())
    return placed.groupBy("user_id").agg(F.count_distinct("p").alias("partitions"), F.count("*").alias("n"))


_DAY, _HOUR = bucket("ts", 86400), bucket("ts", 3600)

QUERIES = {
    "t6_tumbling": (t6_tumble, f"select {_HOUR} as window_start, {_HOUR} + interval 1 hour as window_end, event_type, count(*) as n, max(value) as top from events group by all"),
    "t7_sliding": (t7_hop, f"with e as (select *, unnest([{bucket('ts', 7200)}, {bucket('ts', 7200)} - interval 2 hour, {bucket('ts', 7200)} - interval 4 hour]) as window_start from events) select window_start, window_start + interval 6 hour as window_end, user_id, count(*) as n, max(value) as top, arg_max(event_type, (value, event_id)) as kind from e group by all"),
    "t8_session": (t8_session, "with g as (select *, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as b from events window w as (partition by user_id order by ts)), h as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g) select min(ts) as window_start, max(ts) + interval 2 hour as window_end, user_id, count(*) as n from h group by user_id, k"),
    "t10_count_window": (t10_count_window, "with r as (select *, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as total from events) select user_id, (rn - 1) // 5 + 1 as window_no, count(*) as n, max(value) as top, min(event_id) as first_id from r where (rn - 1) // 5 + 1 <= total // 5 group by 1, 2"),
    "t11_sliding_count": (t11_sliding_count, "with r as (select *, row_number() over (partition by user_id order by event_id) as rn from events) select a.user_id, a.rn // 2 as window_no, count(*) as n, max(b.value) as top, min(b.event_id) as first_id from r a join r b on a.user_id = b.user_id and b.rn between a.rn - 4 and a.rn where a.rn % 2 = 0 group by 1, 2"),
    "t12_window_all": (t12_window_all, f"select {_DAY} as window_start, {_DAY} + interval 1 day as window_end, count(*) as n, count(distinct user_id) as users from events group by all"),
    "t14_cumulate": (t14_cumulate, f"with e as (select *, {_DAY} as window_start, unnest(range(epoch_us(ts) // 7200000000 + 1, epoch_us({_DAY}) // 7200000000 + 13)) as k from events) select window_start, make_timestamp(k * 7200000000) as window_end, event_type, count(*) as n, count(distinct user_id) as users from e group by all"),
    "t16_full_window": (t16_full_window, f"select {bucket('ts', 43200)} as window_start, user_id, cast(count(*) as integer) as n, arg_min(event_id, (ts, event_id)) as first_id, arg_max(event_id, (ts, event_id)) as last_id from events group by all"),
    "t17_refire": (t17_refire, "with a as (select *, (event_id + event_id * 7919 % 97) * 1000000 + event_id as arrived from events), m as (select event_type, arrived, (epoch_us(ts) // 3600000000 + 1) * 3600000000 as e, max(epoch_us(ts)) over (order by arrived rows between unbounded preceding and 1 preceding) - 3600000000 as mark from a), h as (select *, coalesce(e <= mark, false) as late, count(*) over (partition by event_type, e order by arrived) as n from m where coalesce(e + 7200000000 > mark, true)) select event_type, make_timestamp(e) as window_end, 'on time' as fired, null::bigint as arrived, count(*) as n from h where not late group by all union all select event_type, make_timestamp(e), 'late', arrived, n from h where late"),
    "t18_late_split": (t18_late_split, "with a as (select *, (event_id + (event_id * 7919) % 40) * 1000000 + event_id as arrival from events), b as (select *, max(epoch_us(ts)) over (order by arrival rows between unbounded preceding and 1 preceding) as seen from a) select event_id, case when (epoch_us(ts) // 3600000000 + 1) * 3600000000 + 3600000000 <= seen - 1800000000 then 'late' else 'main' end as side from b"),
    "t19_early_fire": (t19_early_fire, f"with e as (select *, {bucket('ts', 21600)} as window_start, unnest(range(epoch_us(ts) // 3600000000 + 1, epoch_us({bucket('ts', 21600)}) // 3600000000 + 6)) as k from events) select window_start, make_timestamp(k * 3600000000) as window_end, user_id, count(*) as n from e group by all"),
    "t20_marker_trigger": (t20_marker, f"with e as (select *, {_DAY} as window_start, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id, {_DAY} order by event_id rows unbounded preceding) as run from events) select user_id, window_start, window_start + interval 1 day as window_end, 'marker' as fired, event_id as at, cast(run as bigint) as n from e where event_type = 'error' union all select user_id, window_start, window_start + interval 1 day, 'end', null, count(*) filter (event_type <> 'error') from e group by user_id, window_start"),
    "j1_window_join": (j1_window_join, _windowed_sql("inner")),
    "j2_cogroup": (j2_cogroup, f"with e as (select user_id, event_id, event_type, {bucket('ts', 21600)} as window_start from events where event_type in ('click', 'purchase')) select user_id, window_start, cast(count(*) filter (event_type = 'click') as integer) as n_left, cast(count(*) filter (event_type = 'purchase') as integer) as n_right, coalesce(string_agg(cast(event_id as varchar), ',' order by event_id) filter (event_type = 'click'), '') as left_ids from e group by all"),
    "j3_window_left": (_windowed("left"), _windowed_sql("left")),
    "j7_window_right": (_windowed("right"), _windowed_sql("right")),
    "j7_window_full": (_windowed("full"), _windowed_sql("full")),
    "j8_window_semi": (_windowed("left_semi"), _windowed_sql("semi")),
    "j9_window_anti": (_windowed("left_anti"), _windowed_sql("anti")),
    "j4_interval": (j4_interval, "select c.user_id, c.event_id as c_event_id, p.event_id as p_event_id from events c join events p on c.user_id = p.user_id and c.event_type = 'click' and p.event_type = 'purchase' and p.ts between c.ts - interval 5 hour and c.ts + interval 10 hour"),
    "j5_interval_cells": (j5_interval_cells, "select a.event_id as a_id, b.event_id as b_id from events a join events b on a.event_type = 'view' and b.event_type = 'error' and b.ts between a.ts and a.ts + interval 120 second"),
    "j10_left_ttl": (j10_left_ttl, "select c.user_id, c.event_id as c_event_id, p.event_id as p_event_id from (select * from events where event_type = 'click') c left join (select * from events where event_type = 'purchase') p on c.user_id = p.user_id and p.ts between c.ts - interval 1 hour and c.ts + interval 1 hour"),
    "j11_full_history": (j11_full_history, "select c_nationkey, count(*) as pairs, max(s_acctbal) as top from customer join supplier on c_nationkey = s_nationkey group by 1"),
    "j12_lookup": (j12_lookup, "select o_orderkey, c_mktsegment as segment from orders left join customer on o_custkey = c_custkey"),
    "j13_asof": (j13_asof, "select p.event_id, v.value as rate, v.event_id as version from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'signup') v on p.user_id = v.user_id and p.ts >= v.ts"),
    "j15_enrich_split": (j15_enrich_split, "select o_orderkey, c_mktsegment, case when c_custkey is null then 'miss' else 'hit' end as side from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey"),
    "j16_enrich_chain": (j16_enrich_chain, "select p_brand as brand, n_name as nation_name, r_name as region_name, count(*) as n from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by all"),
    "j18_reconcile": (j18_reconcile, "with a as (select * from events where event_type = 'purchase'), b as (select * from events where event_type = 'click') select coalesce(a.user_id, b.user_id) as key, case when b.user_id is null then 'right missing' when a.user_id is null then 'left missing' else 'matched' end as status, count(*) as n from a full join b on a.user_id = b.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 group by all"),
    "j19_unnest": (j19_unnest, "select p_partkey, unnest(string_split(p_name, ' ')) as tag from part"),
    "j21_map_side": (lambda s, d: table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"), "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey"),
    "k13_retractions": (k13_retractions, "with m as (select o_orderkey, l_linenumber, o_orderkey * 10 + 3 as ls, l_orderkey * 10 + l_linenumber as rs from orders join lineitem on o_orderkey = l_orderkey and l_returnflag = 'R'), f as (select o.o_orderkey, o.o_orderkey * 10 + 3 as ls, min(rs) as first from orders o left join m on o.o_orderkey = m.o_orderkey group by 1) select o_orderkey, l_linenumber, '+I' as op, greatest(ls, rs) as seq from m union all select o_orderkey, null, '+I', ls from f where first is null or first > ls union all select o_orderkey, null, '-D', first from f where first > ls"),
    "k13_keyed_table": (k13_keyed_table, "select distinct o_orderkey, l_linenumber from orders left join lineitem on o_orderkey = l_orderkey and l_returnflag = 'R'"),
    "j22_range_lookup": (j22_range_lookup, "select o_orderkey, coalesce(n_name, '-1') as n_name from orders left join nation on floor(o_totalprice) between n_nationkey * 40000 and n_nationkey * 40000 + 30000"),
    "r1_global_top": (r1_global_top, "select user_id, n, cast(row_number() over (order by n desc, user_id) as integer) as rn from (select user_id, count(*) as n from events group by 1) qualify rn <= 2"),
    "r2_window_top": (r2_window_top, f"with a as (select {_DAY} as window_start, user_id, count(*) as n, max(value) as top from events group by all) select *, cast(row_number() over (partition by window_start order by n desc, top desc, user_id) as integer) as rn from a qualify rn <= 2"),
    "r2_stream_form": (r2_stream_form, f"with a as (select {_DAY} as window_start, user_id, count(*) as n, max(value) as top from events group by all) select window_start, cast(row_number() over (partition by window_start order by n desc, top desc, user_id desc) as integer) as rn, n, top from a qualify rn <= 2"),
    "r3_raw_top": (r3_raw_top, f"select {bucket('ts', 21600)} as window_start, event_id, value, cast(row_number() over (partition by {bucket('ts', 21600)} order by value desc, event_id) as integer) as rn from events qualify rn <= 2"),
    "r4_top_per_key": (r4_top_per_key, "select c_mktsegment, c_custkey, c_acctbal, cast(row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as integer) as rn from customer qualify rn <= 3"),
    "r5_over_rows": (r5_over_rows, "select event_id, cast(sum(epoch_us(ts) // 1000) over w as bigint) as sum_ms, count(*) over w as n from events window w as (partition by user_id order by event_id rows between 3 preceding and current row)"),
    "r7_hop_top": (r7_hop_top, f"with e as (select user_id, unnest([{bucket('ts', 21600)}, {bucket('ts', 21600)} - interval 6 hour]) as window_start from events), a as (select window_start, user_id, count(*) as n from e group by all) select *, cast(row_number() over (partition by window_start order by n desc, user_id) as integer) as rn from a qualify rn <= 2"),
    "r8_top_average": (r8_top_average, f"with e as (select user_id % 4 as page, event_type, value, unnest([{bucket('ts', 21600)}, {bucket('ts', 21600)} - interval 6 hour]) as window_start from events), a as (select window_start, page, event_type, cast(sum(cast(value as decimal(18,2))) as double) / count(*) as mean from e group by all) select *, cast(row_number() over (partition by window_start, page order by mean desc, event_type) as integer) as rn from a qualify rn <= 2"),
    "r9_top_rows": (r9_top_rows, f"select user_id, {_DAY} as window_start, {_DAY} + interval 1 day as window_end, event_id, value, cast(row_number() over (partition by user_id, {_DAY} order by value desc, event_id) as integer) as rn from events qualify rn <= 2"),
    "r10_window_sort": (r10_window_sort, f"select window_start, v[1] as first, v[2] as second, cast(len(v) as integer) as n from (select {_DAY} as window_start, list_reverse_sort(list(value)) as v from events group by 1)"),
    "d1_shuffle": (d1_shuffle, "select cast(6 as bigint) as partitions, count(*) as n from events"),
    "d2_rescale": (d2_rescale, "select cast(2 as bigint) as partitions, count(*) as n from events"),
    "a11_set_uv": (a11_set_uv, "select cast(date_trunc('day', ts) as timestamp) as window_start, cast(date_trunc('day', ts) as timestamp) + interval 1 day as window_end, event_type, cast(count(distinct user_id) as integer) as uv from events group by all"),
    "s11_snapshot_changes": (s11_snapshot_changes, "select o_orderkey % 900 as id, o_orderstatus, o_orderkey as seq from orders qualify row_number() over (partition by o_orderkey % 900 order by o_orderkey desc) = 1 and (o_orderkey < 900 or o_orderkey % 5 <> 0)"),
    "d4_custom_partition": (d4_custom, "select user_id % 2 as parity, cast(1 as bigint) as partitions, count(*) as n from events group by 1"),
    "d5_key_by": (d5_key_by, "select user_id, cast(1 as bigint) as partitions, count(*) as n from events group by 1"),
}
