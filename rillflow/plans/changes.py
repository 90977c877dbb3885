"""Registered queries: changelogs that streams keep up, with the SQL of every state they go through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..session import table
from ..streaming import changes, patterns, runner, stateful, tables
from .warehouse import _FIRST, _LOG, page_log
from .windowed import ntz


def j10_stream(s, d):
    """Clicks joined to purchases of their user, as long as the user isn't idle for over an hour."""
    rows = runner.as_stream(table(s, d, "events").where("event_type in ('click', 'purchase')"), "event_id", 3).withWatermark("ts", "10 minutes")
    out = changes.ttl_left_join(rows, "user_id", "ts", "event_id", F.col("event_type") == "click", 3600)
    return runner.collected(out).select(F.col("key").alias("user_id"), F.col("left_id").alias("click_id"), F.col("right_id").alias("purchase_id"), "op", "seq")


def a16_stream(s, d):
    """Orders as a keyed table of 500 rows that later orders replace or delete: statistics by status and priority."""
    orders = runner.as_stream(table(s, d, "orders"), "o_orderkey", 3).withColumn("id", F.col("o_orderkey") % 500)
    grp, cents = F.concat_ws("/", "o_orderstatus", "o_orderpriority"), F.round(F.col("o_totalprice") * 100)
    rows = changes.replacements(orders, "id", grp, cents, "o_orderkey", F.col("o_orderstatus") == "P")
    return runner.collected(changes.retracting_stats(rows)).drop("batch_no")


def w13_stream(s, d):
    """The three users of greatest value in each type, where a user has the type and value of the last event."""
    events = runner.as_stream(table(s, d, "events"), "event_id", 3)
    rows = changes.replacements(events, "user_id", F.col("event_type"), F.round(F.col("value") * 100), "event_id", F.lit(False))
    return runner.collected(changes.top_changes(rows, 3)).drop("batch_no")


def t33_stream(s, d):
    """Three patterns over events that arrive out of order: a view with another right after it, a click that some purchase
    follows, and three values over ten in a row; with the matches that ran out of time."""
    events = runner.with_sentinel(table(s, d, "events"), "ts", "event_id").fillna(-1, ["user_id"])
    events = events.withColumn("arrival", F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(40)))
    kind = F.col("event_type")
    wanted = {
        "bounce": ([patterns.Step(kind == "view"), patterns.Step(kind == "view")], 7200),
        "bought": ([patterns.Step(kind == "click"), patterns.Step(kind == "purchase", strict=False)], 86400),
        "three": ([patterns.Step(F.col("value") > 10, times=3)], 86400),
    }
    out = None
    for name, (steps, within_s) in wanted.items():
        rows = runner.as_stream(events, "arrival", 3).withWatermark("ts", "5 days")
        found = runner.collected(patterns.find(rows, "user_id", "ts", "event_id", steps, within_s))
        found = found.where("key >= 0").select(F.lit(name).alias("pattern"), F.col("key").alias("user_id"), "first_seq", "last_seq", "kind")
        out = found if out is None else out.unionByName(found)
    return out


def visitor_windows(log, size: str = "10 seconds", within_s: int = 10):
    """uv, pv, sv, uj and time by area, channel and newness as one streaming plan: bounces and first visits of the day are
    stateful operators of their own, their rows and the log's meet in one window aggregate.

    A bounce is known ``within_s`` seconds after its row at the latest, when windows of that time may be closed. So all
    inputs count by a time that much later, and the windows are set back in the end (their size divides the shift).
    Each input has its own delay; the least watermark holds for all.
    """
    keys, measures = ["ar", "ch", "is_new"], ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
    entry, later = F.col("last_page_id").isNull(), F.expr(f"interval {within_s} seconds")
    part = lambda rows, **own: rows.select("at", *keys, *[own.get(m, F.lit(0)).cast("long").alias(m) for m in measures])
    bounces = patterns.find(log.withWatermark("ts", "2 seconds"), "mid", "ts", "event_id", [patterns.Step(entry), patterns.Step(entry)], within_s, keys)
    first = stateful.apply(
        log.where(entry).withWatermark("ts", "1 second").select("mid", "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), *keys, (F.col("ts") + later).alias("at")).transform(stateful.sharded, "mid"), ["shard"],
        stateful.FirstOfDay("mid", "event_id", "day", ["at", *keys]), "at timestamp, ar string, ch string, is_new int", time_mode="EventTime", event_time="at",
    )
    seen = log.select((F.col("ts") + later).alias("at"), "during", entry.alias("entry"), *keys).withWatermark("at", "3 seconds")
    rows = part(bounces.withColumnRenamed("ts", "at"), uj_ct=F.lit(1)).unionByName(part(first, uv_ct=F.lit(1)))
    rows = rows.unionByName(part(seen, pv_ct=F.lit(1), sv_ct=F.col("entry").cast("long"), dur_sum=F.coalesce("during", F.lit(0))))
    out = windows.tumble(rows, "at", size, keys, [F.sum(m).alias(m) for m in measures])
    return out.withColumns({c: F.col(c) - later for c in ("window_start", "window_end")})


def w8_stream(s, d):
    events = runner.with_sentinel(table(s, d, "events"), "ts", "event_id").fillna(-1, ["user_id"])
    s.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    out = runner.collected(visitor_windows(page_log(runner.as_stream(events, "event_id", 3))))
    return ntz(out.where("ar <> 'ar-1'").drop("batch_no"))


def j14_stream(s, d):
    """Purchases with the rate that the last signup of their tenth of users had set when they came; a signup whose value is
    below ten takes the rate away."""
    rows = runner.as_stream(table(s, d, "events").where("event_type in ('signup', 'purchase')"), "event_id", 3)
    rate = F.when(F.col("value") >= 10, F.col("event_id"))
    out = tables.controlled(rows, "event_id", F.col("user_id") % 10, F.col("event_type") == "signup", rate)
    return runner.collected(out).select(F.col("seq").alias("event_id"), F.col("value").cast("long").alias("rate_id"))


def j17_stream(s, d):
    """What a cache of users does: signups change a user, all other events read one; a day without a read forgets it."""
    rows = runner.as_stream(table(s, d, "events"), "event_id", 3).withWatermark("ts", "10 minutes")
    return runner.collected(tables.cached_dimension(rows, "user_id", "ts", "event_id", F.col("event_type") == "signup", 86_400)).drop("batch_no")


def k17_stream(s, d):
    """Each user's events in chunks of ten; what is left is sent by the timer in the end."""
    events = runner.with_sentinel(table(s, d, "events"), "ts", "event_id", 36_500).fillna(-1, ["user_id"])
    rows = runner.as_stream(events, "event_id", 3).withWatermark("ts", "10 minutes")
    out = runner.collected(tables.buffered(rows, F.col("user_id"), "ts", "event_id", 10, 3650 * 86_400))
    return out.where("bucket >= 0").select(F.col("bucket").alias("user_id"), "chunk_no", "n", "first_seq", "last_seq")


_KEPT = "k as ({rows}), r as (select *, 2 * seq + 1 as a, 2 * lead(seq) over (partition by item order by seq) as b from k), l as (select * from r where not gone), pos as (select grp, a as p from l union select grp, b from l where b is not null)"
_ORDERS = "select o_orderkey % 500 as item, o_orderkey as seq, o_orderstatus || '/' || o_orderpriority as grp, cast(round(o_totalprice * 100) as bigint) as value, o_orderstatus = 'P' as gone from orders"
_LAST = "select user_id as item, event_id as seq, event_type as grp, cast(round(value * 100) as bigint) as value, false as gone from events"

QUERIES = {
    "j10_ttl_join_stream": (j10_stream, "with e as (select user_id, event_id as seq, event_type = 'click' as is_left, ts, ts - lag(ts) over (partition by user_id order by event_id) as idle from events where event_type in ('click', 'purchase')), x as (select *, sum(case when idle is null or epoch_us(ts) // 1000 - epoch_us(ts - idle) // 1000 > 3600000 then 1 else 0 end) over (partition by user_id order by seq) as life from e), l as (select a.user_id, a.seq as click_id, b.seq as purchase_id from x a join x b on a.user_id = b.user_id and a.life = b.life and a.is_left and not b.is_left), alone as (select a.user_id, a.seq, min(b.seq) as first from x a left join x b on a.user_id = b.user_id and a.life = b.life and not b.is_left where a.is_left group by 1, 2 having min(b.seq) is null or min(b.seq) > a.seq) select user_id, click_id, purchase_id, '+I' as op, greatest(click_id, purchase_id) as seq from l union all select user_id, seq, null, '+I', seq from alone union all select user_id, seq, null, '-D', first from alone where first is not null"),
    "a16_retract_stream": (a16_stream, f"with {_KEPT.format(rows=_ORDERS)}, s as (select pos.grp, p, count(value) as n, cast(coalesce(sum(value), 0) as bigint) as total, max(value) as top from pos left join l on l.grp = pos.grp and a <= p and (b is null or b > p) group by 1, 2), d as (select *, lag(n) over w as pn, lag(total) over w as pt, lag(top) over w as px from s window w as (partition by grp order by p)) select grp, case when n > 0 then '-U' else '-D' end as op, pn as n, pt as total, px as top, p as seq from d where pn > 0 union all select grp, case when pn > 0 then '+U' else '+I' end, n, total, top, p from d where n > 0"),
    "w13_top_changelog_stream": (w13_stream, f"with {_KEPT.format(rows=_LAST)}, live as (select pos.grp, p, item, value, row_number() over (partition by pos.grp, p order by value desc, item) as rank from pos join l on l.grp = pos.grp and a <= p and (b is null or b > p) qualify rank <= 3), grid as (select grp, p, unnest([1, 2, 3]) as rank from pos), d as (select grp, p, rank, item, value, lag(item) over w as oi, lag(value) over w as ov from grid left join live using (grp, p, rank) window w as (partition by grp, rank order by p)) select grp, cast(rank as integer) as rank, oi as item, ov as value, '-D' as op, p as seq from d where oi is not null and (oi is distinct from item or ov is distinct from value) union all select grp, cast(rank as integer), item, value, '+I', p from d where item is not null and (oi is distinct from item or ov is distinct from value)"),
    "t33_pattern_stream": (t33_stream, "with e as (select user_id, event_id, epoch_us(ts) // 1000 as ms, event_type = 'view' as v, value > 10 as o, lead(event_id, 1) over w as i1, lead(event_id, 2) over w as i2, lead(epoch_us(ts) // 1000, 1) over w - epoch_us(ts) // 1000 as d1, lead(epoch_us(ts) // 1000, 2) over w - epoch_us(ts) // 1000 as d2, lead(event_type) over w = 'view' as v1, lead(value > 10, 1) over w as o1, lead(value > 10, 2) over w as o2, event_type, min(case when event_type = 'purchase' then event_id end) over (partition by user_id order by event_id rows between 1 following and unbounded following) as buy from events window w as (partition by user_id order by event_id)), b as (select e.*, epoch_us(p.ts) // 1000 - ms as db from e left join events p on p.event_id = buy where e.event_type = 'click') select 'bounce' as pattern, user_id, event_id as first_seq, case when d1 < 7200000 then i1 else event_id end as last_seq, case when d1 < 7200000 then 'match' else 'timeout' end as kind from e where v and (d1 is null or d1 >= 7200000 or v1) union all select 'bought', user_id, event_id, case when db < 86400000 then buy else event_id end, case when db < 86400000 then 'match' else 'timeout' end from b union all select 'three', user_id, event_id, case when d1 is null or d1 >= 86400000 then event_id when d2 is null or d2 >= 86400000 then i1 else i2 end, case when d2 < 86400000 then 'match' else 'timeout' end from e where o and (d1 is null or d1 >= 86400000 or o1 and (d2 is null or d2 >= 86400000 or o2))"),
    "w8_visitor_stats_stream": (w8_stream, f"with log as ({_LOG}), u as (select ts, ar, ch, is_new, 1 as uv, 0 as pv, 0 as sv, 0 as uj, 0 as dur from ({_FIRST}) union all select ts, ar, ch, is_new, 0, 1, 0, 0, during from log union all select ts, ar, ch, is_new, 0, 0, 1, 0, 0 from log where not inner_page union all select make_timestamp(epoch_us(ts) // 1000 * 1000), ar, ch, is_new, 0, 0, 0, 1, 0 from (select * from (select *, lead(inner_page) over w as ni, lead(epoch_us(ts) // 1000) over w - epoch_us(ts) // 1000 as gap from log window w as (partition by mid order by event_id)) where not inner_page and (gap is null or not ni or gap >= 10000))) select make_timestamp(epoch_us(ts) // 10000000 * 10000000) as window_start, make_timestamp(epoch_us(ts) // 10000000 * 10000000) + interval 10 second as window_end, ar, ch, is_new, cast(sum(uv) as bigint) as uv_ct, cast(sum(pv) as bigint) as pv_ct, cast(sum(sv) as bigint) as sv_ct, cast(sum(uj) as bigint) as uj_ct, cast(sum(dur) as bigint) as dur_sum from u group by all"),
    "j14_control_stream": (j14_stream, "select event_id, nullif(r, -1) as rate_id from (select event_id, last_value(case when event_type = 'signup' then case when value >= 10 then event_id else -1 end end ignore nulls) over (partition by user_id % 10 order by event_id rows between unbounded preceding and current row) as r, event_type from events where event_type in ('signup', 'purchase')) where event_type = 'purchase'"),
    "j17_cached_dim_stream": (j17_stream, "with e as (select user_id as id, event_id as seq, event_type = 'signup' as change, lag(event_type) over w <> 'signup' and epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over w <= 86400000 as cached from events window w as (partition by user_id order by event_id)) select id, seq, case when change then case when cached then 'invalidates' else 'passes' end when cached then 'hit' else 'reload' end as outcome from e"),
    "k17_buffered_stream": (k17_stream, "with e as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 10 + 1 as chunk_no from events) select user_id, chunk_no, count(*) as n, min(event_id) as first_seq, max(event_id) as last_seq from e group by all"),
}
