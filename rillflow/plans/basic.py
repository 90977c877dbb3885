"""Registered queries: scans, projection and routing, scalar functions, plain aggregates and user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, udfs
from ..operators import aggs, changelog, project
from ..session import table



def money(c: str, name: str) -> F.Column:
    """A sum in whole cents, which does not depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(name)


def _events(s, d) -> DataFrame:
    return table(s, d, "events")


def _lines(s, d) -> DataFrame:
    """Events as the text lines that a line source reads."""
    return _events(s, d).select(F.concat_ws(", ", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp"))).alias("value"))


def _json(s, d) -> DataFrame:
    return _events(s, d).select("event_id", F.to_json(F.struct("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.from_json("props", "map<string,int>").alias("props"), F.array(F.struct(F.col("event_type").alias("tag"), F.create_map(F.lit("v"), F.col("value")).alias("m"))).alias("items"))).alias("value"))


def s1_text_lines(s, d):
    words = table(s, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return words.agg(F.count("*").alias("n_lines"), F.sum(F.length("line").cast("long")).cast("long").alias("n_chars"))


def s4_line_stream(s, d):
    parts = F.split("value", ",")
    rows = _lines(s, d).select(F.trim(parts[0]).cast("long").alias("user_id"), F.trim(parts[1]).alias("event_type"), F.trim(parts[2]).cast("long").alias("ts"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def s6_topic_table(s, d):
    topic = _events(s, d).select(
        F.to_json(F.struct("user_id")).alias("key"), F.to_json(F.struct("event_type", "value")).alias("value"), F.col("event_id").alias("offset"),
        F.array(F.struct(F.lit("source").alias("key"), F.col("event_type").cast("binary").alias("value"))).alias("headers"),
    )
    headers = F.map_from_entries("headers")
    row = topic.select("offset", F.from_json("key", "user_id long").alias("k"), F.from_json("value", "event_type string, value double").alias("v"), headers["source"].cast("string").alias("source"))
    return row.groupBy("k.user_id", "source").agg(F.count(F.when(F.col("v.event_type") == F.col("source"), 1)).alias("n"), F.max("offset").alias("last_offset"), F.max("v.value").alias("top"))


def s7_keyed_topic(s, d):
    topic = _events(s, d).select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), "event_id")
    return changelog.latest_values(topic, "user_id", "value", "event_id")


def s9_csv_table(s, d):
    text = _events(s, d).select("event_id", F.concat(F.col("event_id"), F.lit(",|"), F.col("event_type"), F.lit("|,"), F.when(F.col("event_id") % 7 == 0, "\\N").when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("user_id").cast("string"))).alias("line"))
    options = {"sep": ",", "quote": "|", "nullValue": "\\N", "mode": "PERMISSIVE"}
    row = text.select("event_id", F.from_csv("line", "id long, kind string, user_id long", options).alias("r"))
    return row.groupBy("r.kind").agg(F.count("*").alias("n"), F.count("r.user_id").alias("n_user"), F.sum("r.user_id").alias("users"))


def s10_json_table(s, d):
    schema = "user_id long, event_type string, ts long, props map<string,int>, items array<struct<tag:string,m:map<string,double>>>"
    row = _json(s, d).select("event_id", F.from_json("value", schema).alias("r"))
    return row.select("event_id", "r.user_id", F.col("r.props")["k"].alias("k"), F.element_at("r.items", 1)["tag"].alias("tag"), F.element_at("r.items", 1)["m"]["v"].alias("v"))


def s12_change_envelopes(s, d):
    o = table(s, d, "orders")
    letter = F.element_at(F.array(*[F.lit(x) for x in "crud"]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    row = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"))
    e = o.select("o_orderkey", F.to_json(F.struct(letter.alias("op"), F.when(letter.isin("u", "d"), row).alias("before"), F.when(letter != "d", row).alias("after"), F.struct(F.lit("shop").alias("db"), F.lit("orders").alias("table")).alias("source"))).alias("value"))
    out = changelog.normalise_cdc(e, "value")
    return out.select("o_orderkey", "database", "table_name", "type", F.col("before")["status"].alias("old_status"), F.col("after")["status"].alias("new_status"), F.size("before").alias("n_before"))


def s13_catalog_view(s, d):
    _events(s, d).createOrReplaceTempView("rill_events")
    return s.sql("select event_type, count(*) as n, max(value) as top from rill_events where value > 10 group by event_type")


def p1_map(s, d):
    return table(s, d, "pages").select("page_id", F.length("url").alias("url_length"))


def p3_flat_map(s, d):
    both = F.when(F.col("event_type") == "click", F.array(F.col("user_id").cast("string"))).otherwise(F.array(F.col("user_id").cast("string"), "event_type"))
    return _events(s, d).select("event_id", F.explode(both).alias("out"))


def p4_flatten(s, d):
    per = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty")))).alias("items"))
    return project.flatten(per, "items", ["no", "part", "qty"], at_most=3)


def _replicated(lines: DataFrame) -> DataFrame:
    seeded = F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("copy") * 13, F.lit(90)) + 10
    return project.replicate(lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("cnt")), "cnt").withColumn("load", seeded)


def p5_replicate(s, d):
    return _replicated(table(s, d, "lineitem"))


def p6_multi_emit(s, d):
    e = _events(s, d).select("event_id", "event_type", "user_id")
    kind = F.col("event_type")
    out = project.multi_emit(e, [(kind == "click", F.lit("seen click")), (kind == "error", F.col("event_type")), (kind == "error", F.col("event_type")), (None, F.concat_ws("/", "event_type", "user_id"))])
    return out.select("event_id", "pos", "out")


def p11_dirty_json(s, d):
    broken = _json(s, d).withColumn("value", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{oops "), "value")).otherwise(F.col("value")))
    clean, dirty = project.parse_json(broken, "value", "user_id long, event_type string")
    return clean.select("event_id", "event_type", F.lit("clean").alias("side")).unionByName(dirty.select("event_id", F.lit(None).cast("string").alias("event_type"), F.lit("dirty").alias("side")))


def p12_valid_json(s, d):
    mixed = _json(s, d).withColumn("value", F.when(F.col("event_id") % 5 == 0, F.lit("plain line")).otherwise(F.col("value")))
    return project.only_json(mixed, "value").agg(F.count("*").alias("n"))


def p13_event_day(s, d):
    return project.event_day(_json(s, d), "value").groupBy("dt").agg(F.count("*").alias("n"))


def p14_side_outputs(s, d):
    out = project.split(_events(s, d), {"big": F.col("value") > 50, "errors": F.col("event_type") == "error"})
    frames = [df.select(F.lit(name).alias("output"), "event_id", "value") for name, df in out.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _app_log(e: DataFrame) -> DataFrame:
    log = e.select(
        "event_id", F.concat(F.lit("page"), F.col("user_id") % 5).alias("page_id"), F.when(F.col("event_type") == "signup", "{}").otherwise("").alias("start"),
        F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), lambda k: F.concat_ws("-", F.lit("item"), k)).alias("displays"),
    )
    return project.app_log(log).groupBy("kind", "page_id").agg(F.count("*").alias("n"), F.count("item").alias("n_items"))


def p15_app_log(s, d):
    return _app_log(_events(s, d))


def p16_route_by_config(s, d):
    o = table(s, d, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "insert").when(F.col("o_orderstatus") == "O", "update").otherwise("delete")
    named = F.when(F.col("o_orderkey") % 3 == 0, "order_info").otherwise("order_log")
    changes = o.select("o_orderkey", named.alias("table_name"), op.alias("op"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("prio"), F.col("o_orderpriority")).alias("after"))
    config = s.createDataFrame(
        [("order_info", "insert", "kafka", "dwd_order", "id,cust"), ("order_info", "update", "hbase", "dim_order", "id,prio"), ("order_log", "insert", "hbase", "dim_log", "id")],
        "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string",
    )
    out = project.route_by_config(changes, config)
    return out.select("o_orderkey", "sink_type", "sink_table", F.array_join(F.array_sort(F.map_keys("after")), ",").alias("columns"), F.col("after")["cust"].alias("cust"))


def p18_co_map(s, d):
    e = _events(s, d)
    left, right = e.where("event_type = 'click'"), e.where("event_type = 'view'")
    out = project.co_map(left, right, F.concat(F.lit("rill_"), (F.col("user_id") * 10).cast("string")), F.concat(F.lit("rill_"), F.upper("event_type")))
    return out.groupBy("side", "out").agg(F.count("*").alias("n"))


def p19_order_times(s, d):
    at = F.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(s, d, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("create_date"), F.date_format(at, "HH").alias("create_hour"), F.unix_millis(at).alias("create_ts"))


def a3_max_field(s, d):
    return aggs.max_field(_events(s, d), ["user_id"], "value", "event_id", ["event_type", "event_id"])


def a3_max_by(s, d):
    return aggs.max_row(_events(s, d), ["user_id"], "value", "event_id", ["value", "event_type", "event_id"])


def a4_argmax_later(s, d):
    e = _events(s, d).withColumn("v", F.floor(F.col("value") / 10))
    return aggs.max_row(e, ["user_id"], "v", "event_id", ["v", "event_type", "event_id"], later_wins=True)


def a5_most_active(s, d):
    per = _events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return per.agg(F.max_by(F.struct("user_id", "n"), F.struct("n", "last")).alias("r")).select("r.*")


def a6_sum_latest(s, d):
    return aggs.sum_with_latest(_events(s, d), ["user_id"], F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), "total", "event_id", ["event_type", "props"])


def a7_group_by(s, d):
    avg = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")
    return table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), money("o_totalprice", "total"), avg.alias("mean"))


def a9_average_time(s, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _events(s, d).groupBy("user_id").agg(F.expr("sum(unix_millis(cast(ts as timestamp))) div count(*)").alias("avg_ms"), F.min(ms).alias("first_ms"))


def a10_pv_uv(s, d):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return _events(s, d).groupBy(day).agg(F.count("*").alias("pv"), F.count_distinct("user_id").alias("uv"), aggs.ratio(F.count("*"), F.count_distinct("user_id")).alias("pv_uv"))


def a14_distinct_orders(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))


def a15_conditional(s, d):
    n = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(f"{k}s")
    return _events(s, d).groupBy("user_id").agg(n("click"), n("view"), n("purchase"), F.sum(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), 1).otherwise(0)).alias("good"))


def a16_changelog_group(s, d):
    changes = table(s, d, "orders").select((F.col("o_orderkey") % 500).alias("id"), "o_custkey", "o_totalprice", "o_orderstatus", F.col("o_orderkey").alias("seq"))
    last = changelog.apply_changelog(changes, ["id"], "seq", F.col("o_orderstatus") == "P")
    return last.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), money("o_totalprice", "total"))


def c3_java_hash(s, d):
    return table(s, d, "customer").select("c_custkey", scalars.java_hash("c_name").alias("h"))


def c4_times(s, d):
    at = F.col("ts").cast("timestamp")
    return _events(s, d).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"), F.unix_millis(at).alias("ms"), scalars.from_millis(F.unix_millis(at)).alias("local"), scalars.to_millis(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("back"), scalars.window_floor(F.unix_millis(at), 10_000).alias("floor_ms"))


def c7_age(s, d):
    return table(s, d, "orders").select("o_orderkey", scalars.age("o_orderdate", F.lit("2024-01-01").cast("date")).alias("age"))


def c11_merge(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left").withColumn("seg", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return j.select("o_orderkey", *scalars.merge_rows(["seg"], ["c_mktsegment"]))


def c14_tokens(s, d):
    words = table(s, d, "documents").select(F.explode(scalars.tokens("text")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def c14_segments(s, d):
    """Names written without gaps, segmented by the words of all names."""
    part = table(s, d, "part")
    segment = udfs.segmenter(udfs.dictionary_of(part.select(F.explode(F.split("p_name", " ")))))
    return part.select("p_partkey", F.posexplode(segment(F.replace("p_name", F.lit(" ")))).alias("pos", "word"))


def u1_scalar_udf(s, d):
    udfs.register(s)
    table(s, d, "customer").createOrReplaceTempView("rill_customer")
    return s.sql("select c_custkey, my_upper(c_name) as name from rill_customer")


def u2_table_udf(s, d):
    udfs.register(s)
    table(s, d, "part").createOrReplaceTempView("rill_part")
    return s.sql("select p_partkey, w.word, w.length from rill_part, lateral split_words(p_name, ' ') w")


def c12_property_copy(s, d):
    """Columns of two rows as one, those that clash renamed; the payment's own win."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("create_time"), F.col("o_totalprice").alias("amount"))
    paid = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("create_time"), (F.col("o_totalprice") * 2).alias("amount"))
    j = paid.alias("p").join(o.alias("o"), F.col("p.id") == F.col("o.o_orderkey"))
    return j.select(F.col("p.id").alias("payment_id"), F.col("p.create_time").alias("payment_create_time"), F.col("o.create_time").alias("order_create_time"), F.col("p.amount").alias("amount"))


def j20_lateral_outer(s, d):
    """A table function joined to each row; a row it gives nothing for stays with nulls."""
    words = F.filter(F.split("p_name", " "), lambda w: F.length(w) > 4)
    return table(s, d, "part").select("p_partkey", F.explode_outer(words).alias("word"))


def t37_observed(s, d):
    """Counters of processed rows beside the result."""
    from pyspark.sql import Observation

    seen = Observation("events")
    kept = _events(s, d).observe(seen, F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    kept.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["n"], seen.get["errors"])], "n long, errors long")


def u3_weighted(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(aggs.weighted_average("l_extendedprice", "cast(l_quantity as int)").alias("w_avg"))


def u4_top_two(s, d):
    return aggs.top_two(table(s, d, "orders"), ["o_custkey"], "o_totalprice").select("o_custkey", "rank", "value")


QUERIES = {
    "s1_text_lines": (s1_text_lines, "select count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from (select unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)"),
    "s4_line_stream": (s4_line_stream, "select user_id, event_type, count(*) as n, max(epoch_us(ts) // 1000) as last_ts from events group by all"),
    "s6_topic_table": (s6_topic_table, "select user_id, event_type as source, count(*) as n, max(event_id) as last_offset, max(value) as top from events group by all"),
    "s7_keyed_topic": (s7_keyed_topic, "select user_id, arg_max(event_type, event_id) as value from events group by user_id having arg_max(event_type, event_id) <> 'error'"),
    "s9_csv_table": (s9_csv_table, "select event_type as kind, count(*) as n, count(u) as n_user, cast(sum(u) as bigint) as users from (select event_type, case when event_id % 7 <> 0 and event_id % 11 <> 0 then user_id end as u from events) group by all"),
    "s10_json_table": (s10_json_table, "select event_id, user_id, cast(json_extract(props, '$.k') as integer) as k, event_type as tag, value as v from events"),
    "s12_change_envelopes": (s12_change_envelopes, "select o_orderkey, 'shop' as database, 'orders' as table_name, (['insert', 'insert', 'update', 'delete'])[o_orderkey % 4 + 1] as type, case when o_orderkey % 4 >= 2 then o_orderstatus end as old_status, case when o_orderkey % 4 < 3 then o_orderstatus end as new_status, case when o_orderkey % 4 >= 2 then 2 else 0 end as n_before from orders"),
    "s13_catalog_view": (s13_catalog_view, "select event_type, count(*) as n, max(value) as top from events where value > 10 group by event_type"),
    "p1_map": (p1_map, "select page_id, cast(length(url) as integer) as url_length from pages"),
    "p2_filter": (lambda s, d: _events(s, d).where((F.col("event_type") == "click") & (F.col("value") > 20)).select("event_id", "user_id", "value"), "select event_id, user_id, value from events where event_type = 'click' and value > 20"),
    "p3_flat_map": (p3_flat_map, "select event_id, unnest(case when event_type = 'click' then [cast(user_id as varchar)] else [cast(user_id as varchar), event_type] end) as out from events"),
    "p4_flatten": (p4_flatten, "select l_orderkey, l_linenumber as no, l_partkey as part, l_quantity as qty from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) <= 3)"),
    "p5_replicate": (p5_replicate, "select l_orderkey, l_linenumber, l_partkey, cnt, cast(copy as integer) as copy, (l_orderkey * 31 + l_linenumber * 7 + copy * 13) % 90 + 10 as load from (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as integer) as cnt, unnest(range(1, cast(l_quantity as integer) + 1)) as copy from lineitem)"),
    "p6_multi_emit": (p6_multi_emit, "select event_id, cast(unnest(range(len(o))) as integer) as pos, unnest(o) as out from (select event_id, case event_type when 'click' then ['seen click', event_type || '/' || user_id] when 'error' then [event_type, event_type, event_type || '/' || user_id] else [event_type || '/' || user_id] end as o from events)"),
    "p7_select_where": (lambda s, d: table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), "select o_orderkey as id, o_custkey as customer from orders where o_totalprice > 200000"),
    "p8_computed": (lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 10).alias("size10"), (F.col("p_partkey") * 10).alias("big_id")), "select p_partkey as id, p_size + 10 as size10, p_partkey * 10 as big_id from part"),
    "p10_nested_access": (lambda s, d: s10_json_table(s, d).groupBy("tag").agg(F.max("v").alias("top"), F.sum("k").alias("ks")), "select event_type as tag, max(value) as top, cast(sum(cast(json_extract(props, '$.k') as integer)) as bigint) as ks from events group by 1"),
    "p11_dirty_json": (p11_dirty_json, "select event_id, case when event_id % 9 <> 0 then event_type end as event_type, case when event_id % 9 = 0 then 'dirty' else 'clean' end as side from events"),
    "p12_valid_json": (p12_valid_json, "select count(*) as n from events where event_id % 5 <> 0"),
    "p13_event_day": (p13_event_day, "select strftime(ts, '%Y-%m-%d') as dt, count(*) as n from events group by 1"),
    "p14_side_outputs": (p14_side_outputs, "select case when value > 50 then 'big' when event_type = 'error' then 'errors' else 'main' end as output, event_id, value from events"),
    "p15_app_log": (p15_app_log, "with l as (select event_id, 'page' || (user_id % 5) as page_id, event_type = 'signup' as st, event_id % 3 + 1 as n from events) select kind, page_id, count(*) as n, count(item) as n_items from (select case when st then 'start' else 'page' end as kind, page_id, null as item from l union all select 'display', page_id, unnest(range(n)) from l where not st) group by all"),
    "p16_route_by_config": (p16_route_by_config, "select o_orderkey, t.sink_type, t.sink_table, t.columns, case when t.columns = 'cust,id' then cast(o_custkey as varchar) end as cust from orders join (values ('order_info', 'F', 'kafka', 'dwd_order', 'cust,id'), ('order_info', 'O', 'hbase', 'dim_order', 'id,prio'), ('order_log', 'F', 'hbase', 'dim_log', 'id')) t(src, st, sink_type, sink_table, columns) on o_orderstatus = st and src = case when o_orderkey % 3 = 0 then 'order_info' else 'order_log' end"),
    "p18_co_map": (p18_co_map, "select side, out, count(*) as n from (select 'left' as side, 'rill_' || (user_id * 10) as out from events where event_type = 'click' union all select 'right', 'rill_VIEW' from events where event_type = 'view') group by all"),
    "p19_order_times": (p19_order_times, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as create_date, strftime(o_orderdate, '%H') as create_hour, epoch_ms(o_orderdate) as create_ts from orders"),
    "a1_word_count": (lambda s, d: aggs.word_count(table(s, d, "documents"), "text"), "select word, count(*) as n from (select unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) as word from documents) where word <> '' group by word"),
    "a2_rolling": (lambda s, d: aggs.rolling(_events(s, d), ["user_id"], ["event_id"], {"so_far": F.count("*"), "top": F.max("value")}).select("event_id", "user_id", "so_far", "top"), "select event_id, user_id, count(*) over w as so_far, max(value) over w as top from events window w as (partition by user_id order by event_id rows unbounded preceding)"),
    "a3_max_field": (a3_max_field, "select user_id, max(value) as value, arg_min(event_type, event_id) as event_type, min(event_id) as event_id from events group by user_id"),
    "a3_max_by": (a3_max_by, "select user_id, value, event_type, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events) where n = 1"),
    "a4_argmax_later": (a4_argmax_later, "select user_id, v, event_type, event_id from (select *, cast(floor(value / 10) as bigint) as v, row_number() over (partition by user_id order by floor(value / 10) desc, event_id desc) as n from events) where n = 1"),
    "a5_most_active": (a5_most_active, "select user_id, count(*) as n from events group by user_id order by n desc, max(event_id) desc limit 1"),
    "a6_sum_latest": (a6_sum_latest, "select user_id, cast(sum(cast(value as decimal(18,2))) as double) as total, arg_max(event_type, event_id) as event_type, arg_max(props, event_id) as props from events group by user_id"),
    "a7_group_by": (a7_group_by, "select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as top, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as mean from orders group by all"),
    "a8_count_distinct": (lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers")), "select o_orderpriority, count(distinct o_custkey) as customers from orders group by 1"),
    "a9_average_time": (a9_average_time, "select user_id, cast(sum(epoch_us(ts) // 1000) // count(*) as bigint) as avg_ms, min(epoch_us(ts) // 1000) as first_ms from events group by 1"),
    "a10_pv_uv": (a10_pv_uv, "select strftime(ts, '%Y-%m-%d') as day, count(*) as pv, count(distinct user_id) as uv, count(*) / count(distinct user_id) as pv_uv from events group by 1"),
    "a14_distinct_orders": (a14_distinct_orders, "select l_partkey, count(distinct l_orderkey) as orders, count(distinct case when l_returnflag = 'R' then l_orderkey end) as returned from lineitem group by 1"),
    "a15_conditional": (a15_conditional, "select user_id, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'purchase') as purchases, count(*) filter (event_type = 'purchase' and value > 50) as good from events group by 1"),
    "a16_changelog_group": (a16_changelog_group, "select o_orderstatus, count(*) as n, max(o_totalprice) as top, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from (select *, row_number() over (partition by o_orderkey % 500 order by o_orderkey desc) as n from orders) where n = 1 and o_orderstatus <> 'P' group by 1"),
    "c1_split_trim": (lambda s, d: table(s, d, "pages").select("page_id", F.element_at(F.split("url", r"\?"), 1).alias("base"), F.size(F.split("url", r"\W+")).alias("parts")), "select page_id, string_split(url, '?')[1] as base, cast(len(regexp_split_to_array(url, '[^a-zA-Z0-9_]+')) as integer) as parts from pages"),
    "c2_strings": (lambda s, d: table(s, d, "customer").select("c_custkey", F.upper(F.substring("c_name", 1, 4)).alias("up"), F.lower("c_mktsegment").alias("low"), F.length("c_name").alias("len"), F.col("c_name").startswith("Customer#00000000").alias("first"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("tag")), "select c_custkey, upper(substr(c_name, 1, 4)) as up, lower(c_mktsegment) as low, cast(length(c_name) as integer) as len, starts_with(c_name, 'Customer#00000000') as first, c_mktsegment || '-' || c_nationkey as tag from customer"),
    "c3_java_hash": (c3_java_hash, "select c_custkey, cast(list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(c_name, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) as integer) as h from customer"),
    "c4_times": (c4_times, "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as text, epoch_us(ts) // 1000 as ms, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M:%S') as local, epoch_ms(date_trunc('second', ts)) - 28800000 as back, epoch_us(ts) // 10000000 * 10000 as floor_ms from events"),
    "c5_intervals": (lambda s, d: table(s, d, "orders").where("o_orderdate between date'1997-01-01' and date'1997-01-01' + interval 90 days").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 36 hours")).alias("due")), "select o_orderkey, o_orderdate + interval 36 hour as due from orders where o_orderdate between date '1997-01-01' and date '1997-01-01' + interval 90 day"),
    "c7_age": (c7_age, "select o_orderkey, cast(floor(date_diff('day', o_orderdate, date '2024-01-01') / 365) as integer) as age from orders"),
    "c8_modulo": (lambda s, d: table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("m"), F.expr("o_orderkey div 7").alias("q")), "select o_orderkey, o_orderkey % 7 as m, o_orderkey // 7 as q from orders"),
    "c9_arrays": (lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("first"), F.size(F.split("p_name", " ")).alias("n"), F.create_map(F.lit("size"), "p_size")["size"].alias("size")), "select p_partkey, string_split(p_name, ' ')[1] as first, cast(len(string_split(p_name, ' ')) as integer) as n, p_size as size from part"),
    "c10_json_get_put": (lambda s, d: _events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("t"))).alias("made")), "select event_id, cast(json_extract(props, '$.k') as integer) as k, '{\"k\":' || json_extract(props, '$.k') || ',\"t\":\"' || event_type || '\"}' as made from events"),
    "c11_merge": (c11_merge, "select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_orderpriority end, c_mktsegment) as seg from orders left join customer on o_custkey = c_custkey"),
    "c12_property_copy": (c12_property_copy, "select o_orderkey as payment_id, o_orderdate + interval 1 day as payment_create_time, o_orderdate as order_create_time, o_totalprice * 2 as amount from orders where o_orderstatus = 'F'"),
    "j20_lateral_outer": (j20_lateral_outer, "select p_partkey, unnest(case when len(w) = 0 then [null] else w end) as word from (select p_partkey, list_filter(string_split(p_name, ' '), lambda x: length(x) > 4) as w from part)"),
    "t37_observed": (t37_observed, "select count(*) as n, count(*) filter (event_type = 'error') as errors from events"),
    "c13_casts": (lambda s, d: table(s, d, "part").select("p_partkey", F.expr("try_cast(replace(p_brand, 'Brand#', '') as int)").alias("brand_no"), F.expr("try_cast(p_type as int)").alias("none"), F.col("p_retailprice").cast("long").alias("whole")), "select p_partkey, try_cast(replace(p_brand, 'Brand#', '') as integer) as brand_no, try_cast(p_type as integer) as none, cast(trunc(p_retailprice) as bigint) as whole from part"),
    "c14_tokens": (c14_tokens, "select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from documents) group by 1"),
    "c14_segments": (c14_segments, "with d as (select string_agg(w, '|' order by length(w) desc, w) || '|.' as pattern from (select distinct unnest(string_split(p_name, ' ')) as w from part) where w <> ''), g as (select p_partkey, regexp_extract_all(replace(p_name, ' ', ''), pattern) as ws from part, d) select p_partkey, cast(unnest(range(len(ws))) as integer) as pos, unnest(ws) as word from g"),
    "u1_scalar_udf": (u1_scalar_udf, "select c_custkey, upper(c_name) as name from customer"),
    "u2_table_udf": (u2_table_udf, "select p_partkey, word, cast(length(word) as integer) as length from (select p_partkey, unnest(string_split(p_name, ' ')) as word from part) where word <> ''"),
    "u3_weighted_average": (u3_weighted, "select l_suppkey, cast(sum(cast(trunc(l_extendedprice) as bigint) * cast(l_quantity as integer)) // sum(cast(l_quantity as integer)) as bigint) as w_avg from lineitem group by 1"),
    "u4_top_two": (u4_top_two, "select o_custkey, cast(n as integer) as rank, o_totalprice as value from (select *, row_number() over (partition by o_custkey order by o_totalprice desc) as n from orders) where n <= 2"),
}
