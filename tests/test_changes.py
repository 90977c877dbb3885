"""Changelogs, patterns and several inputs on streams, on small rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from rillflow.operators import windows
from rillflow.streaming import changes, patterns, runner

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_idle_keys_forget(spark):
    rows = [(1, 0, True), (1, 3600, False), (2, 0, True), (2, 3601, False), (3, 0, False), (3, 3600, True), (3, 7200, True), (3, 10801, True), (4, 5, True), (None, 6, True), (None, 7, False)]
    rows = [(k, i, at(s), left) for i, (k, s, left) in enumerate(sorted(rows, key=lambda r: r[1]))]
    df = runner.as_stream(spark.createDataFrame(rows, "k long, seq long, ts timestamp, is_left boolean"), "seq", 4).withWatermark("ts", "1 second")
    out = runner.collected(changes.ttl_left_join(df, "k", "ts", "seq", F.col("is_left"), 3600))
    when = {r[1]: int((r[2] - START).total_seconds()) for r in rows}
    got = sorted(((r.key, when[r.left_id], when.get(r.right_id), r.op) for r in out.collect()), key=str)
    want = [
        (1, 0, None, "+I"), (1, 0, None, "-D"), (1, 0, 3600, "+I"), (2, 0, None, "+I"), (3, 3600, 0, "+I"), (3, 7200, 0, "+I"), (3, 10801, None, "+I"),
        (4, 5, None, "+I"), (None, 6, None, "+I"), (None, 6, None, "-D"), (None, 6, 7, "+I"),
    ]
    assert got == sorted(want, key=str)


def slow_matches(rows, chain, within_ms):
    """(key, first, last, kind) of rows (key, ms, seq, flags), each first row on its own."""
    out = []
    keys = {}
    for key, ms, seq, flags in sorted(rows, key=lambda r: r[1:3]):
        keys.setdefault(key, []).append((ms, seq, flags))
    for key, own in keys.items():
        for i, (since, first, flags) in enumerate(own):
            if not flags[chain[0][0]]:
                continue
            state, last, kind = 1, first, "timeout"
            if len(chain) == 1:
                kind = "match"
            for ms, seq, now in own[i + 1 :] if len(chain) > 1 else ():
                if ms - since >= within_ms:
                    break
                condition, strict = chain[state]
                if now[condition]:
                    state, last = state + 1, seq
                    if state == len(chain):
                        kind = "match"
                        break
                elif strict:
                    kind = None
                    break
            if kind:
                out.append((key, first, last, kind))
    return sorted(out)


def test_patterns_of_rows_out_of_order(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for seq in range(300):
        t += rng.choice([0, 200, 1000, 4000])
        rows.append((rng.randrange(4), t, seq, rng.choice("abc")))
    table = [(k, at(ms / 1000), seq, x, seq + rng.randrange(20)) for k, ms, seq, x in rows] + [(-1, at(10**6), 1000, "z", 1000)]
    df = spark.createDataFrame(table, "k long, ts timestamp, seq long, x string, arrival long")
    is_ = lambda c: F.col("x") == c
    cases = [
        ([patterns.Step(is_("a")), patterns.Step(is_("b"), strict=False, times=2, consecutive=False), patterns.Step(is_("c"), strict=False)], "abc"),
        ([patterns.Step(is_("a"), times=2, consecutive=True), patterns.Step(is_("b"), strict=False)], "ab"),
        ([patterns.Step(is_("c"))], "c"),
    ]
    for steps, names in cases:
        stream = runner.as_stream(df, "arrival", 5).withWatermark("ts", "60 seconds")
        found = runner.collected(patterns.find(stream, "k", "ts", "seq", steps, 9, ["x"])).where("key >= 0").collect()
        flags = [(k, ms, seq, [x == c for c in names]) for k, ms, seq, x in rows]
        assert sorted((r.key, r.first_seq, r.last_seq, r.kind) for r in found) == slow_matches(flags, patterns.compiled(steps), 9000)
        assert {r.x for r in found} == {names[0]}


def test_no_window_closes_before_the_slowest_input(spark):
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")

    def closed(last_of_second):
        parts = []
        for name, delay, rows in (("a", "1 second", range(0, 100, 5)), ("b", "2 seconds", range(0, last_of_second, 5))):
            df = spark.createDataFrame([(i, at(s), name) for i, s in enumerate(rows)], "i long, ts timestamp, source string")
            parts.append(runner.as_stream(df, "i", 2).withWatermark("ts", delay))
        out = windows.tumble(parts[0].unionByName(parts[1]), "ts", "10 seconds", ["source"], [F.count("*").alias("n")])
        return sorted((r.window_start.second + 60 * r.window_start.minute, r.source) for r in runner.collected(out).collect())

    assert closed(20) == [(0, "a"), (0, "b")]  # the second input ends at 15 s, less two of delay
    assert max(closed(100))[0] == 80


def test_top_of_changes(spark):
    rng = random.Random(6)
    live, rows, want, seq = {}, [], [], 0
    for _ in range(200):
        seq += 1
        before = sorted(((-v, i) for i, v in live.items()))[:2]
        item = rng.randrange(12)
        if item in live:
            rows.append(("g", item, live.pop(item), seq, False))
        if rng.random() < 0.7:
            live[item] = rng.randrange(20)
            rows.append(("g", item, live[item], seq, True))
        after = sorted(((-v, i) for i, v in live.items()))[:2]
        for rank in range(2):
            old, new = before[rank : rank + 1], after[rank : rank + 1]
            if old != new:
                want += [("g", rank + 1, i, -v, op, seq) for own, op in ((old, "-D"), (new, "+I")) for v, i in own]
    df = spark.createDataFrame(rows, "grp string, item long, value long, seq long, add boolean")
    out = runner.collected(changes.top_changes(runner.as_stream(df, "seq", 3), 2, parts=3)).drop("batch_no")
    assert sorted(map(tuple, out.collect())) == sorted(want)
