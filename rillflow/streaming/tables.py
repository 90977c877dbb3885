"""Streams beside a table that changes: control rows in flight, cached dimensions, and buffers that outlive a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stateful import HeldRows, ShardTimer, apply, sharded, together


class ControlTable(StatefulProcessor):
    """Rows with the value that a table of control rows has for their name when they come; map state holds the table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getMapState("table", "name string", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known: dict[str, str | None] = {}
        changed, out = set(), []
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for seq, name, control, value in zip(*(pdf[c].tolist() for c in ("seq", "name", "control", "value"))):
            if control:
                known[name] = value
                changed.add(name)
                continue
            if name not in known:
                known[name] = self.table.getValue((name,))[0] if self.table.containsKey((name,)) else None
            out.append((seq, known[name]))
        for name in changed:
            if known[name] is not None:
                self.table.updateValue((name,), (known[name],))
            elif self.table.containsKey((name,)):
                self.table.removeKey((name,))
        yield pd.DataFrame(out, columns=["seq", "value"]).astype({"seq": "int64", "value": "object"})

    def close(self) -> None:
        pass


def controlled(rows: DataFrame, seq: str, name: Column, control: Column, value: Column, parts: int = 8) -> DataFrame:
    """(seq, value): each row that isn't ``control`` with the value of the last control row of its name that came before
    it; null before the first, and after one whose value is null.

    Control rows go to each of ``parts`` copies of the table, data rows to one by hash, so a name that most rows have isn't
    one key's work. ``seq`` is the order of arrival.
    """
    slim = rows.select(F.col(seq).cast("long").alias("seq"), name.cast("string").alias("name"), F.coalesce(control, F.lit(False)).alias("control"), value.cast("string").alias("value"))
    all_parts = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = slim.withColumn("part", F.explode(F.when(F.col("control"), all_parts).otherwise(F.array(F.pmod(F.hash("seq"), F.lit(parts))))))
    return apply(dealt, ["part"], ControlTable(), "seq long, value string")


class CachedDimension(StatefulProcessor):
    """A dimension row in a cache: reads find it for ``expiry_ms`` after the last read, a change removes it.

    A read is a ``hit`` or a ``reload``, which caches; a change ``invalidates`` what is cached, or ``passes``. A timer of
    event time removes a row that nobody reads any more.
    """

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.read.get()[0] if self.read.exists() else None
        last, out = before, []
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for seq, ms, change in zip(*(pdf[c].tolist() for c in ("seq", "ms", "change"))):
            cached = last is not None and ms - last <= self.expiry_ms
            out.append((seq, ("invalidates" if cached else "passes") if change else "hit" if cached else "reload"))
            last = None if change else ms
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.expiry_ms + 1)
            if last is None:
                self.read.clear()
            else:
                self.read.update((last,))
                self.handle.registerTimer(last + self.expiry_ms + 1)
        out = pd.DataFrame(out, columns=["seq", "outcome"])
        out.insert(0, "id", key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.read.clear()
        yield pd.DataFrame({"id": [], "seq": [], "outcome": []}).astype({"id": "int64", "seq": "int64", "outcome": "object"})

    def close(self) -> None:
        pass


def cached_dimension(rows: DataFrame, dim: str, ts: str, seq: str, change: Column, expiry_s: int) -> DataFrame:
    """(id, seq, outcome) of each read and change of a dimension row, in a stream with a watermark on ``ts``; a reload is
    what a join to the dimension's table must answer, a hit isn't."""
    at = F.col(ts).cast("timestamp")
    slim = rows.select(F.col(dim).cast("long").alias("id"), at.alias("ts"), F.unix_millis(at).alias("ms"), F.col(seq).cast("long").alias("seq"), F.coalesce(change, F.lit(False)).alias("change"))
    return apply(slim, ["id"], CachedDimension(expiry_s * 1000), "id long, seq long, outcome string", time_mode="EventTime")


class Buffer(StatefulProcessor):
    """Holds each key's rows and sends them ``n`` at a time, or what there is ``wait_ms`` after the first that waits, for the
    keys of a shard.

    The time is that of the rows: one that comes so late or later first sends what waits, and where none comes the
    watermark does. Held rows are state, so a stream that is stopped and started again sends them with the next ones.
    """

    def __init__(self, n: int, wait_ms: int):
        self.n, self.wait_ms = n, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = HeldRows(handle, "held", {"bucket": "object", "seq": "int64", "ms": "int64"})
        self.sent = HeldRows(handle, "sent", {"bucket": "object", "n": "int64"})
        self.timer = ShardTimer(handle)

    def _run(self, new: pd.DataFrame | None, due: int | None) -> Iterator[pd.DataFrame]:
        """``due``: what waits for this time or an earlier one is sent after the rows."""
        held: dict[str | None, list] = {}
        for bucket, seq, ms in self.held.get().itertuples(index=False, name=None):
            held.setdefault(bucket, []).append((seq, ms))
        sent, out = dict(self.sent.get().itertuples(index=False, name=None)), []

        def send(bucket, own: list) -> None:
            sent[bucket] = sent.get(bucket, 0) + 1
            out.append((bucket, sent[bucket], len(own), own[0][0], own[-1][0]))
            own.clear()

        for bucket, seq, ms in zip(*(new[c].tolist() for c in ("bucket", "seq", "ms"))) if new is not None else ():
            own = held.setdefault(bucket, [])
            if own and ms >= own[0][1] + self.wait_ms:
                send(bucket, own)
            own.append((seq, ms))
            if len(own) == self.n:
                send(bucket, own)
        for bucket, own in held.items():
            if due is not None and own and own[0][1] + self.wait_ms <= due:
                send(bucket, own)
        self.held.put(pd.DataFrame([(bucket, *r) for bucket, own in held.items() for r in own], columns=list(self.held.types)))
        self.sent.put(pd.DataFrame(list(sent.items()), columns=list(self.sent.types)))
        self.timer.set(min((own[0][1] + self.wait_ms for own in held.values() if own), default=None))
        yield pd.DataFrame(out, columns=["bucket", "chunk_no", "n", "first_seq", "last_seq"]).astype({"bucket": "object", "chunk_no": "int64", "n": "int64", "first_seq": "int64", "last_seq": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._run(together(rows, "seq"), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.fired(expiredTimerInfo.getExpiryTimeInMs())
        yield from self._run(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, bucket: Column, ts: str, seq: str, n: int, wait_s: int) -> DataFrame:
    """(bucket, chunk_no, n, first_seq, last_seq) of each chunk that a buffer of ``n`` rows sends, one buffer for each bucket;
    the stream has a watermark on ``ts``."""
    at = F.col(ts).cast("timestamp")
    slim = rows.select(bucket.cast("long").cast("string").alias("bucket"), at.alias("ts"), F.unix_millis(at).alias("ms"), F.col(seq).cast("long").alias("seq"))
    out = apply(sharded(slim, "bucket"), ["shard"], Buffer(n, wait_s * 1000), "bucket string, chunk_no long, n long, first_seq long, last_seq long", time_mode="EventTime")
    return out.withColumn("bucket", F.col("bucket").cast("long"))
