"""The layered warehouse: raw changes and logs, detail, wide facts and window statistics, over the given tables.

Orders and line items stand for order facts, events for the page log, customers, parts, suppliers, nations and regions
for the dimensions. Each layer is a function of frames, so batch and stream use the same code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggs, changelog, joins, project, sequences, windows
from ..session import table
from .basic import money


def page_log(events: DataFrame) -> DataFrame:
    """Events as page views: views are entries (no last page), errors count as displays."""
    return events.select(
        "event_id", "ts", F.col("user_id").alias("mid"), F.concat(F.lit("page"), (F.col("value").cast("int") % 5).cast("string")).alias("page_id"),
        F.when(F.col("event_type") != "view", F.lit("home")).alias("last_page_id"), F.concat(F.lit("ch"), F.col("user_id") % 3).alias("ch"),
        F.concat(F.lit("ar"), F.col("user_id") % 4).alias("ar"), (F.col("event_id") % 3 == 0).cast("int").alias("is_new"), F.get_json_object("props", "$.k").cast("long").alias("during"),
        "event_type",
    )


def w1_change_capture(s, d):
    c = table(s, d, "customer")
    row = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), F.col("c_name"))
    raw = c.select(F.to_json(F.struct(F.lit("r").alias("op"), F.lit(None).cast("map<string,string>").alias("before"), row.alias("after"), F.struct(F.lit("shop").alias("db"), F.lit("user_info").alias("table")).alias("source"))).alias("value"))
    out = changelog.normalise_cdc(raw, "value")
    return out.select(F.concat_ws(".", "database", "table_name").alias("topic"), F.col("after")["id"].alias("key"), "type", F.to_json("after").alias("value"))


def w2_page_log(s, d):
    raw = page_log(table(s, d, "events"))
    repaired = sequences.repair_is_new(raw, "mid", ["event_id"])
    routed = project.route(repaired, {"start": F.col("event_type") == "signup"}, rest="page")
    displays = F.when(F.pmod("during", F.lit(4)) > 0, F.sequence(F.lit(1).cast("long"), F.pmod("during", F.lit(4))))  # what the page showed
    shown = routed.where("route = 'page' and event_type = 'error'").withColumn("shown", F.explode(displays)).drop("shown").withColumn("route", F.lit("display"))
    return routed.unionByName(shown).groupBy("route", "is_new").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def w3_fact_dim_routing(s, d):
    """Changes of orders and customers by configuration: facts to the main output, dimensions to a keyed snapshot."""
    o, c = table(s, d, "orders"), table(s, d, "customer")
    maps = "map<string,string>"
    facts = o.select(F.col("o_orderkey").alias("seq"), F.lit("order_info").alias("table_name"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("insert").alias("op"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("total"), F.col("o_totalprice").cast("string")).cast(maps).alias("after"))
    users = c.select(F.col("c_custkey").alias("seq"), F.lit("user_info").alias("table_name"), F.lit("insert").alias("op"), F.create_map(F.lit("id"), (F.col("c_custkey") % 700).cast("string"), F.lit("name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment")).cast(maps).alias("after"))
    config = s.createDataFrame([("order_info", "insert", "kafka", "dwd_order_info", "id"), ("user_info", "insert", "hbase", "dim_user_info", "id,name")], "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string")
    routed = project.route_by_config(facts.unionByName(users), config)
    main = routed.where("sink_type = 'kafka'").groupBy("sink_table").agg(F.count("*").alias("n"), F.max(F.size("after")).alias("columns"), F.lit(None).cast("string").alias("last_name"))
    rows = routed.where("sink_type = 'hbase'").select("sink_table", "seq", F.col("after")["id"].alias("id"), F.col("after")["name"].alias("name"), F.size("after").alias("columns"))
    snapshot = changelog.apply_changelog(rows, ["sink_table", "id"], "seq", F.lit(False))
    side = snapshot.groupBy("sink_table").agg(F.count("*").alias("n"), F.max("columns").alias("columns"), F.max("name").alias("last_name"))
    return main.unionByName(side)


def order_wide(s, d, upper: str = "3650 days") -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    wide = joins.interval_join(o, line, [("o_orderkey", "l_orderkey")], "o_orderdate", "l_shipdate", "-5 days", upper)
    dims = [
        (table(s, d, "customer"), "o_custkey", "c_custkey", {"c_mktsegment": "segment", "c_nationkey": "nation"}),
        (table(s, d, "nation"), "nation", "n_nationkey", {"n_name": "province", "n_regionkey": "region"}),
        (table(s, d, "region"), "region", "r_regionkey", {"r_name": "area"}),
        (table(s, d, "part"), "l_partkey", "p_partkey", {"p_name": "sku_name", "p_brand": "brand", "p_type": "category"}),
        (table(s, d, "supplier"), "l_suppkey", "s_suppkey", {"s_name": "supplier"}),
    ]
    out = joins.enrich(wide, dims)
    return out.withColumns({"create_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "age": scalars.age("o_orderdate", F.lit("2024-01-01").cast("date"))})


_WIDE = "orders join lineitem on o_orderkey = l_orderkey and l_shipdate between o_orderdate - interval 5 day and o_orderdate + interval 1000 day left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey"


def w4_order_wide(s, d):
    return order_wide(s, d).select("o_orderkey", "l_linenumber", "create_date", "age", "segment", "province", "area", "sku_name", "brand", "supplier")


def w5_payment_wide(s, d):
    """Payments (finished orders) joined to order details that came within the bound before them."""
    wide = order_wide(s, d, "1000 days").select("o_orderkey", "l_linenumber", "o_orderdate", "l_extendedprice", "province")
    paid = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pay_order"), (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, cast(o_orderkey % 30 as int))")).alias("pay_time"), F.col("o_totalprice").alias("payment"))
    out = joins.interval_join(paid, wide, [("pay_order", "o_orderkey")], "pay_time", "o_orderdate", "-15 minutes", "5 seconds")
    return out.select("pay_order", "l_linenumber", "payment", "province", F.date_format("pay_time", "yyyy-MM-dd HH:mm:ss").alias("pay_text"))


def w6_unique_visit(s, d):
    return sequences.daily_first(page_log(table(s, d, "events")), "mid", "ts", ["event_id"], F.col("last_page_id").isNull()).groupBy("mid").agg(F.count("*").alias("days"))


def w7_bounce(s, d):
    return sequences.bounce(page_log(table(s, d, "events")), "mid", "ts", ["event_id"], F.col("last_page_id").isNull(), 10).select("event_id", "mid", "page_id")


def visitor_stats(log: DataFrame, size: str = "1 day") -> DataFrame:
    """uv, pv, sv, uj and time by area, channel and newness in windows. The log is laid in each visitor's order once, which
    tells entries, first entries of a day and bounces; one aggregate follows."""
    own = Window.partitionBy("mid").orderBy("event_id")
    entry, day, us = F.col("last_page_id").isNull(), F.to_date("ts"), F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.last(F.when(entry, day), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.lead(us).over(own) - us
    marked = log.select(
        "ts", "ar", "ch", "is_new", "during", entry.alias("sv"), (entry & (before.isNull() | (before != day))).alias("uv"),
        (entry & (gap.isNull() | F.lead(entry).over(own) | (gap >= 10_000_000))).alias("uj"),
    )
    count = lambda c: F.count_if(c).cast("double").alias(f"{c}_ct")
    return windows.tumble(marked, "ts", size, ["ar", "ch", "is_new"], [count("uv"), F.count("*").cast("double").alias("pv_ct"), count("sv"), count("uj"), F.sum("during").cast("double").alias("dur_sum")])


def w8_visitor_stats(s, d):
    return visitor_stats(page_log(table(s, d, "events")))


def w9_product_stats(s, d):
    """Clicks of events and orders, payments and refunds of line items by part, with the part's dimensions. Each table is read
    once; lines are grouped by order first, so that no row is expanded for a distinct count."""
    month = lambda c: F.date_trunc("month", c).cast("timestamp_ntz").alias("dt")
    kind, paid = F.col("event_type"), F.col("l_linestatus") == "F"
    seen = table(s, d, "events").where(kind.isin("click", "view")).groupBy(month("ts"), (F.col("event_id") % 100).alias("sku")).agg(F.count_if(kind == "click").alias("click_ct"), F.count_if(kind == "view").alias("display_ct"))
    exact = lambda c: F.col(c).cast("decimal(18,2)")
    price = exact("l_extendedprice")
    sums = {"order_sku_num": exact("l_quantity"), "order_amount": price, "paid_amount": F.when(paid, price), "refund_amount": F.when(F.col("l_returnflag") == "R", price)}
    orders = table(s, d, "lineitem").groupBy(month("l_shipdate"), F.col("l_partkey").alias("sku"), "l_orderkey").agg(*[F.sum(c).alias(m) for m, c in sums.items()], F.max(paid).alias("paid"))
    sold = orders.groupBy("dt", "sku").agg(*[F.sum(m).alias(m) for m in sums], F.count("*").alias("order_ct"), F.count_if("paid").alias("paid_order_ct"))
    measures = ["click_ct", "display_ct", *sums, "order_ct", "paid_order_ct"]
    both = seen.unionByName(sold, allowMissingColumns=True).groupBy("dt", "sku")
    stats = both.agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long" if m in measures[-2:] else "double").alias(m) for m in measures])
    return joins.enrich(stats, [(table(s, d, "part"), "sku", "p_partkey", {"p_name": "sku_name", "p_brand": "brand"})])


_TEN = "10 seconds"
#: Rows of a part that product windows are grouped in, about.
PART_ROWS = 250_000


def product_windows(events: DataFrame, line: DataFrame, part: DataFrame) -> DataFrame:
    """Thirteen measures by product in windows of ten seconds, with its four dimensions.

    Orders are counted by grouping the lines by order first, so that no row is expanded for a distinct count. Events:
    views are displays, signups favourites, purchases carts, errors comments, good ones of even k.

    Few rows share a group, so a task that groups what it reads would hold nearly all of it. Rows are dealt out by their
    group first, to as many parts as the rows ask for.
    """
    parts = max(events.sparkSession.sparkContext.defaultParallelism, -(-(events.count() + line.count()) // PART_ROWS))
    kind, good = F.col("event_type"), F.get_json_object("props", "$.k").cast("long") % 2 == 0
    kinds = {"display_ct": kind == "view", "click_ct": kind == "click", "favor_ct": kind == "signup", "cart_ct": kind == "purchase", "comment_ct": kind == "error", "good_comment_ct": (kind == "error") & good}
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    start = lambda ts: F.window(ts, _TEN)["start"].alias("window_start")
    seen = events.select(start("ts"), (F.col("event_id") % 100).alias("sku"), *[one(c).alias(m) for m, c in kinds.items()])
    exact = lambda c: F.col(c).cast("decimal(18,2)")
    lines = line.select(start("l_shipdate"), F.col("l_partkey").alias("sku"), "l_orderkey", exact("l_quantity").alias("quantity"), exact("l_extendedprice").alias("price"), (F.col("l_linestatus") == "F").alias("paid"), (F.col("l_returnflag") == "R").alias("back"))
    sums = {"order_sku_num": F.col("quantity"), "order_amount": F.col("price"), "payment_amount": F.when(F.col("paid"), F.col("price")), "refund_amount": F.when(F.col("back"), F.col("price"))}
    keys = ["window_start", "sku"]
    orders = lines.repartition(parts, *keys, "l_orderkey").groupBy(*keys, "l_orderkey").agg(*[F.sum(c).alias(m) for m, c in sums.items()], F.max("paid").alias("paid"), F.max("back").alias("back"))
    sold = orders.select(*keys, *sums, F.lit(1).cast("long").alias("order_ct"), one(F.col("paid")).alias("paid_order_ct"), one(F.col("back")).alias("refund_order_ct"))
    measures = [*kinds, "order_ct", "paid_order_ct", "refund_order_ct"]
    rows = seen.unionByName(sold, allowMissingColumns=True).repartition(parts, *keys)
    both = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("double" if m in sums else "long").alias(m) for m in (*measures, *sums)])
    wide = joins.enrich(both, [(part, "sku", "p_partkey", {"p_name": "sku_name", "p_retailprice": "sku_price", "p_type": "category", "p_brand": "trademark"})])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    end = F.col("window_start") + F.expr(f"interval {_TEN}")
    return wide.select(text("window_start").alias("stt"), text(end).alias("edt"), *[c for c in wide.columns if c != "window_start"], F.concat("trademark", F.lit(" "), "category").alias("spu"))


def w9_product_windows(s, d):
    return product_windows(table(s, d, "events"), table(s, d, "lineitem"), table(s, d, "part"))


def w10_province_stats(s, d):
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    wide = joins.enrich(o, [(c, "o_custkey", "c_custkey", {"c_nationkey": "nation"}), (n, "nation", "n_nationkey", {"n_name": "province"})])
    out = windows.tumble(wide, "o_orderdate", "30 days", ["province"], [money("o_totalprice", "order_amount"), F.count_distinct("o_orderkey").alias("order_count")])
    return out.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), "window_end": F.date_format("window_end", "yyyy-MM-dd HH:mm:ss")})


def w11_keyword_stats(s, d):
    """Words of users in windows of ten seconds; a turn's time is a second, two seconds a conversation."""
    said = table(s, d, "conversations").where("role = 'user' and text is not null")
    said = said.select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, conv_id * 2 + turn)").alias("ts"), F.explode(scalars.tokens("text")).alias("keyword"))
    out = windows.tumble(said, "ts", _TEN, ["keyword"], [F.count("*").alias("ct")])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(text("window_start").alias("stt"), text("window_end").alias("edt"), "keyword", "ct", F.lit("SEARCH").alias("source"))


def w12_event_users(s, d):
    """Expand by count, enrich or split, argmax by group; rows whose random load 7 divides form a side output."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 4).alias("cnt"))
    wide = project.replicate(e, "cnt").withColumn("load", F.pmod(F.col("event_id") * 31 + F.col("copy") * 17, F.lit(90)) + 10)
    dim = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("grp"))
    hit, miss = joins.enrich_split(wide, dim, "user_id")
    best = aggs.max_row(hit.withColumn("o", F.col("event_id") * 10 + F.col("copy")), ["grp"], "load", "o", ["event_id", "copy", "load"], later_wins=True)
    out = best.select(F.lit("best").alias("side"), "grp", "event_id", "copy", "load")
    seven = hit.where("load % 7 = 0").groupBy("grp").agg(F.max("event_id").alias("event_id"), F.lit(0).alias("copy"), F.count("*").alias("load"))
    lost = miss.groupBy(F.lit("none").alias("grp")).agg(F.max("event_id").alias("event_id"), F.lit(0).alias("copy"), F.count("*").alias("load"))
    return out.unionByName(seven.select(F.lit("sevens").alias("side"), "*")).unionByName(lost.select(F.lit("miss").alias("side"), "*"))


def w13_top_chain(s, d):
    """Top three of each segment, those of odd nation, as a keyed table, aggregated again."""
    top = aggs.top_n(table(s, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    odd = top.where("c_nationkey % 2 = 1").select("c_mktsegment", "rn", "c_acctbal", "c_custkey")
    keyed = changelog.latest_values(odd.withColumn("k", F.concat_ws("#", "c_mktsegment", "rn")), "k", "c_acctbal", "c_custkey")
    return keyed.groupBy(F.substring_index("k", "#", 1).alias("segment")).agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top"))


_LOG = "select event_id, ts, user_id as mid, 'page' || (cast(trunc(value) as integer) % 5) as page_id, event_type <> 'view' as inner_page, 'ch' || (user_id % 3) as ch, 'ar' || (user_id % 4) as ar, case when event_id % 3 = 0 then 1 else 0 end as is_new, cast(json_extract(props, '$.k') as bigint) as during, event_type from events"
_BOUNCE = "select * from (select *, lead(inner_page) over w as ni, lead(ts) over w as ns from log window w as (partition by mid order by event_id)) where not inner_page and (ns is null or not ni or ns - ts >= interval 10 second)"
_FIRST = "select * from log where not inner_page qualify lag(cast(ts as date)) over (partition by mid order by event_id) is distinct from cast(ts as date)"
_MONTH = lambda c: f"date_trunc('month', {c})"

QUERIES = {
    "w1_change_capture": (w1_change_capture, "select 'shop.user_info' as topic, cast(c_custkey as varchar) as key, 'insert' as type, '{\"id\":\"' || c_custkey || '\",\"name\":\"' || c_name || '\"}' as value from customer"),
    "w2_page_log": (w2_page_log, f"with log as ({_LOG}), r as (select *, case when is_new = 1 and sum(is_new) over (partition by mid order by event_id rows unbounded preceding) > 1 then 0 else is_new end as fixed from log), o as (select case when event_type = 'signup' then 'start' else 'page' end as route, fixed, event_id, event_type, during from r) select route, fixed as is_new, count(*) as n, max(event_id) as last_id from (select * exclude during from o union all select 'display', fixed, event_id, event_type from o, range(during % 4) where event_type = 'error') group by all"),
    "w3_fact_dim_routing": (w3_fact_dim_routing, "select 'dwd_order_info' as sink_table, count(*) as n, 1 as columns, null as last_name from orders where o_orderstatus <> 'P' union all select 'dim_user_info', count(*), 2, max(name) from (select c_custkey % 700 as id, arg_max(c_name, c_custkey) as name from customer group by 1)"),
    "w4_order_wide": (w4_order_wide, f"select o_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') as create_date, cast(floor(date_diff('day', o_orderdate, date '2024-01-01') / 365) as integer) as age, c_mktsegment as segment, n_name as province, r_name as area, p_name as sku_name, p_brand as brand, s_name as supplier from {_WIDE.replace('1000 day', '3650 day')}"),
    "w5_payment_wide": (w5_payment_wide, f"select o_orderkey as pay_order, l_linenumber, o_totalprice as payment, n_name as province, strftime(o_orderdate + to_minutes(o_orderkey % 30), '%Y-%m-%d %H:%M:%S') as pay_text from {_WIDE} where o_orderstatus = 'F' and o_orderkey % 30 <= 15"),
    "w6_unique_visit": (w6_unique_visit, f"with log as ({_LOG}) select mid, count(*) as days from ({_FIRST}) group by 1"),
    "w7_bounce": (w7_bounce, f"with log as ({_LOG}) select event_id, mid, page_id from ({_BOUNCE})"),
    "w8_visitor_stats": (w8_visitor_stats, f"with log as ({_LOG}), u as (select ts, ar, ch, is_new, 1 as uv, 0 as pv, 0 as sv, 0 as uj, 0 as dur from ({_FIRST}) union all select ts, ar, ch, is_new, 0, 1, 0, 0, during from log union all select ts, ar, ch, is_new, 0, 0, 1, 0, 0 from log where not inner_page union all select ts, ar, ch, is_new, 0, 0, 0, 1, 0 from ({_BOUNCE})) select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end, ar, ch, is_new, cast(sum(uv) as double) as uv_ct, cast(sum(pv) as double) as pv_ct, cast(sum(sv) as double) as sv_ct, cast(sum(uj) as double) as uj_ct, cast(sum(dur) as double) as dur_sum from u group by date_trunc('day', ts), ar, ch, is_new"),
    "w9_product_stats": (w9_product_stats, f"with u as (select {_MONTH('ts')} as dt, event_id % 100 as sku, case when event_type = 'click' then 1 else 0 end as a, case when event_type = 'view' then 1 else 0 end as b, 0.0 as q, 0.0 as o, 0.0 as p, 0.0 as r, null as k, null as kp from events where event_type in ('click', 'view') union all select {_MONTH('l_shipdate')}, l_partkey, 0, 0, l_quantity, l_extendedprice, case when l_linestatus = 'F' then l_extendedprice else 0 end, case when l_returnflag = 'R' then l_extendedprice else 0 end, l_orderkey, case when l_linestatus = 'F' then l_orderkey end from lineitem), g as (select cast(dt as timestamp) as dt, sku, cast(sum(a) as double) as click_ct, cast(sum(b) as double) as display_ct, cast(sum(cast(q as decimal(18,2))) as double) as order_sku_num, cast(sum(cast(o as decimal(18,2))) as double) as order_amount, cast(sum(cast(p as decimal(18,2))) as double) as paid_amount, cast(sum(cast(r as decimal(18,2))) as double) as refund_amount, count(distinct k) as order_ct, count(distinct kp) as paid_order_ct from u group by all) select g.*, p_name as sku_name, p_brand as brand from g left join part on sku = p_partkey"),
    "w9_product_windows": (w9_product_windows, "with e as (select epoch_us(ts) // 10000000 as w, event_id % 100 as sku, count(*) filter (event_type = 'view') as display_ct, count(*) filter (event_type = 'click') as click_ct, count(*) filter (event_type = 'signup') as favor_ct, count(*) filter (event_type = 'purchase') as cart_ct, count(*) filter (event_type = 'error') as comment_ct, count(*) filter (event_type = 'error' and cast(json_extract(props, '$.k') as bigint) % 2 = 0) as good_comment_ct from events group by all), x as (select epoch_us(l_shipdate) // 10000000 as w, l_partkey as sku, l_orderkey as k, cast(l_quantity as decimal(18,2)) as q, cast(l_extendedprice as decimal(18,2)) as p, l_linestatus = 'F' as paid, l_returnflag = 'R' as back from lineitem), l as (select w, sku, sum(q) as order_sku_num, sum(p) as order_amount, sum(p) filter (paid) as payment_amount, sum(p) filter (back) as refund_amount, count(distinct k) as order_ct, count(distinct k) filter (paid) as paid_order_ct, count(distinct k) filter (back) as refund_order_ct from x group by all) select strftime(make_timestamp(w * 10000000), '%Y-%m-%d %H:%M:%S') as stt, strftime(make_timestamp(w * 10000000 + 10000000), '%Y-%m-%d %H:%M:%S') as edt, sku, " + ", ".join(f"coalesce({m}, 0) as {m}" for m in "display_ct click_ct favor_ct cart_ct comment_ct good_comment_ct order_ct paid_order_ct refund_order_ct".split()) + ", " + ", ".join(f"cast(coalesce({m}, 0) as double) as {m}" for m in "order_sku_num order_amount payment_amount refund_amount".split()) + ", p_name as sku_name, p_retailprice as sku_price, p_type as category, p_brand as trademark, p_brand || ' ' || p_type as spu from e full join l using (w, sku) left join part on sku = p_partkey"),
    "w11_keyword_stats": (w11_keyword_stats, "with k as (select (conv_id * 2 + turn) // 10 * 10 as w, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as keyword from conversations where role = 'user') select strftime(timestamp '2024-01-01' + to_seconds(w), '%Y-%m-%d %H:%M:%S') as stt, strftime(timestamp '2024-01-01' + to_seconds(w + 10), '%Y-%m-%d %H:%M:%S') as edt, keyword, count(*) as ct, 'SEARCH' as source from k group by w, keyword"),
    "w10_province_stats": (w10_province_stats,"with o as (select n_name as province, make_timestamp(epoch_us(o_orderdate) // 2592000000000 * 2592000000000) as w, o_totalprice, o_orderkey from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey) select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, strftime(w + interval 30 day, '%Y-%m-%d %H:%M:%S') as window_end, province, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as order_amount, count(distinct o_orderkey) as order_count from o group by w, province"),
    "w12_event_users": (w12_event_users, "with x as (select event_id, user_id, copy, (event_id * 31 + copy * 17) % 90 + 10 as load from (select event_id, user_id, unnest(range(1, event_id % 4 + 1)) as copy from events)), h as (select x.*, c_mktsegment as grp from x join customer on user_id = c_custkey and c_acctbal > 0) select 'best' as side, grp, event_id, copy, load from h qualify row_number() over (partition by grp order by load desc, event_id desc, copy desc) = 1 union all select 'sevens', grp, max(event_id), 0, count(*) from h where load % 7 = 0 group by grp union all select 'miss', 'none', max(event_id), 0, count(*) from x where user_id not in (select c_custkey from customer where c_acctbal > 0) having count(*) > 0"),
    "w13_top_chain": (w13_top_chain, "with t as (select * from customer qualify row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) <= 3) select c_mktsegment as segment, count(*) as n, max(c_acctbal) as top from t where c_nationkey % 2 = 1 group by 1"),
}
