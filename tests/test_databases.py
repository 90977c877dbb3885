"""Database sinks that fail and repeat, buffers over a restart, and running maxima in pieces."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from rillflow.operators import windows
from rillflow.plans.databases import LostOnce
from rillflow.sources import database
from rillflow.streaming import runner, tables


@pytest.fixture
def url():
    return f"jdbc:derby:memory:test{uuid.uuid4().hex};create=true"


def test_a_batch_takes_effect_once(spark, url):
    types = {"id": "BIGINT", "v": "VARCHAR(20)", "seq": "BIGINT", "gone": "BOOLEAN"}
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string, seq long, gone boolean")
    rows = lambda: sorted(map(tuple, database.read_split(spark, url, "t", "id", 3).select("id", "v").collect()))
    sink = database.transactional(url, "t", types, ["id"], "seq", "gone", wait_s=0, commit=LostOnce(False))
    sink(frame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 3, False), (3, None, 4, False)]), 0)
    assert rows() == [(1, "b"), (2, "c"), (3, None)]
    sink(frame([(9, "repeated", 9, False)]), 0)  # the number is noted: nothing happens
    assert rows() == [(1, "b"), (2, "c"), (3, None)]
    sink(frame([(2, "x", 5, True), (4, "never", 6, True), (5, "e", 7, False)]), 1)
    assert rows() == [(1, "b"), (3, None), (5, "e")]

    def broken(spark, url, name, batch_id, change):
        raise ConnectionError("no database")

    with pytest.raises(ConnectionError):
        database.transactional(url, "t", types, ["id"], "seq", "gone", retries=2, wait_s=0, commit=broken)(frame([(7, "h", 1, False)]), 2)
    assert rows() == [(1, "b"), (3, None), (5, "e")]
    sink(frame([(7, "h", 1, False)]), 2)  # what the failed one had staged is gone
    assert rows() == [(1, "b"), (3, None), (5, "e"), (7, "h")]
    sink(frame([]), 3)
    assert database.committed(spark, url, "t", 3) and not database.committed(spark, url, "t", 4)


def test_statements_are_one_transaction(spark, url):
    database.execute(spark, url, "CREATE TABLE n (i BIGINT PRIMARY KEY)", "INSERT INTO n VALUES (1)")
    with pytest.raises(Exception, match="duplicate|SQLIntegrity"):
        database.execute(spark, url, "INSERT INTO n VALUES (2)", "INSERT INTO n VALUES (1)")
    assert database.read_split(spark, url, "n", "i", 2).count() == 1
    assert database.exists(spark, url, "n") and not database.exists(spark, url, "missing")


def test_a_stopped_buffer_goes_on(spark, tmp_path):
    start, src, mark, out = dt.datetime(2024, 1, 1), str(tmp_path / "in"), str(tmp_path / "mark"), []
    frame = lambda ids, step: spark.createDataFrame([(i, start + dt.timedelta(seconds=step * i)) for i in ids], "id long, ts timestamp")

    def run(rows):
        rows.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, ts timestamp").parquet(src).withWatermark("ts", "0 seconds")
        found = tables.buffered(stream, F.lit(0), "ts", "id", 10, 3600)
        out.clear()
        runner.run_to_end(found, lambda batch, _: out.extend(tuple(r)[1:] for r in batch.collect()), checkpoint=mark)
        return list(out)

    assert run(frame(range(17), 1)) == [(1, 10, 0, 9)]  # seven are held
    assert run(frame(range(17, 20), 1)) == [(2, 10, 10, 19)]
    assert run(frame(range(20, 23), 1)) == []
    assert run(frame([30], 500)) == [(3, 3, 20, 22)]  # over an hour after the first that waits
    assert run(frame([60], 500)) == [(4, 1, 30, 30)]


def test_running_maximum_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECE_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, rng.randrange(1000)) for i in rng.sample(range(1000), 300)] + [(10**15, 5), (10**15 + 1, 2000)]
    for own in (True, False):
        df = windows.high_water(spark.createDataFrame(rows, "o long, v long"), F.col("v"), "o", "top", own)
        assert df.columns == ["o", "v", "top"]
        got = {r.o: r.top for r in df.collect()}
        best, want = None, {}
        for o, v in sorted(rows):
            want[o] = (v if best is None else max(best, v)) if own else best
            best = v if best is None else max(best, v)
        assert got == want
