"""Patterns of a key's rows on streams: a chain of steps as an automaton, with a time limit and its timeouts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stateful import HeldRows, ShardTimer, apply, sharded, together


@dataclass(frozen=True)
class Step:
    """A row that fulfils ``matches``, ``times`` of them. ``strict``: it is the very next row of the key, else rows
    between are skipped; ``consecutive`` says the same of the repeated ones."""

    matches: Column
    strict: bool = True
    times: int = 1
    consecutive: bool = True


def compiled(steps: list[Step]) -> list[tuple[int, bool]]:
    """The automaton: (number of the condition, strict) for each state; the first row may stand anywhere."""
    return [(k, step.strict if n == 0 else step.consecutive) for k, step in enumerate(steps) for n in range(step.times)]


class Automaton(StatefulProcessor):
    """Runs ``chain`` over each key's rows in the order of their time, once the watermark has passed them, for the keys of a shard.

    Each row that fulfils the first state begins a match of its own. A row ``within_ms`` or more after a match's first
    ends it by timeout, and so does the watermark, by a timer; a strict state that the next row doesn't fulfil ends it
    without a word. State: rows that wait for the watermark, and open matches (first row's seq and time, state, last
    seq), both with what is carried of the first row.
    """

    def __init__(self, chain: list[tuple[int, bool]], within_ms: int):
        self.chain, self.within_ms = chain, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = HeldRows(handle, "rows", {"key": "object", "ms": "int64", "seq": "int64", "flags": "int64", "carried": "object"})
        self.open = HeldRows(handle, "open", {"key": "object", "seq": "int64", "ms": "int64", "state": "int64", "last": "int64", "carried": "object"})
        self.timer = ShardTimer(handle)

    def _step(self, held: list[tuple], row: tuple, out: list[tuple]) -> list[tuple]:
        """The open matches of a key after a row; those that end go to ``out``."""
        key, ms, seq, flags, carried = row
        kept = []
        for m in [*held, (key, seq, ms, 0, seq, carried)]:
            _, first, since, state, last, own = m
            if ms - since >= self.within_ms:
                out.append((*m, "timeout"))
                continue
            condition, strict = self.chain[state]
            if flags >> condition & 1:
                if state + 1 == len(self.chain):
                    out.append((key, first, since, state, seq, own, "match"))
                else:
                    kept.append((key, first, since, state + 1, seq, own))
            elif state and not strict:
                kept.append(m)
        return kept

    def _run(self, new: pd.DataFrame | None, mark: int) -> Iterator[pd.DataFrame]:
        pdf = self.rows.get()
        if new is not None:
            pdf = pd.concat([pdf, new[list(self.rows.types)]], ignore_index=True) if len(pdf) else new
        past = pdf["ms"] < mark  # rows of the watermark's own millisecond may still come
        waiting, passed = pdf[~past], pdf[past].sort_values(["ms", "seq"], kind="stable")
        held: dict[str | None, list[tuple]] = {}
        for m in self.open.get().itertuples(index=False, name=None):
            held.setdefault(m[0], []).append(m)
        out: list[tuple] = []
        for row in zip(*(passed[c].tolist() for c in self.rows.types)):
            held[row[0]] = self._step(held.get(row[0], []), row, out)
        left = []
        for m in (m for own in held.values() for m in own):
            if m[2] + self.within_ms <= mark:
                out.append((*m, "timeout"))
            else:
                left.append(m)
        self.open.put(pd.DataFrame(left, columns=list(self.open.types)))
        self.rows.put(waiting)
        due = [m[2] + self.within_ms for m in left] + ([int(waiting["ms"].min()) + 1] if len(waiting) else [])
        self.timer.set(min(due, default=None))
        pdf = pd.DataFrame(out, columns=["key", "first_seq", "ms", "state", "last_seq", "carried", "kind"])
        pdf["ts"] = pd.to_datetime(pdf["ms"].astype("int64") + self.within_ms, unit="ms", utc=True)
        yield pdf[["key", "first_seq", "last_seq", "kind", "carried", "ts"]].astype({"key": "object", "first_seq": "int64", "last_seq": "int64", "kind": "object", "carried": "object"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._run(together(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.fired(expiredTimerInfo.getExpiryTimeInMs())
        yield from self._run(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def find(rows: DataFrame, key: str, ts: str, seq: str, steps: list[Step], within_s: int, carry: list[str] | None = None) -> DataFrame:
    """(key, first_seq, last_seq, kind, ts, and the first row's ``carry``): matches and timeouts of a pattern in a stream
    with a watermark on ``ts``.

    Rows may come in any order that the watermark allows; equal times (in milliseconds) go by ``seq``. A timeout's
    last_seq is the last row it had. ``ts`` is the first row's time and the limit, which no watermark has passed before;
    it is the event time for what follows in the stream. Conditions that are null don't hold.
    """
    at, own = F.col(ts).cast("timestamp"), carry or []
    flags = sum((F.when(F.coalesce(step.matches, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, step in enumerate(steps)), F.lit(0)).cast("long")
    carried = F.to_json(F.struct(*own)) if own else F.lit("")
    slim = rows.select(F.col(key).cast("long").cast("string").alias("key"), at.alias("ts"), F.unix_millis(at).alias("ms"), F.col(seq).cast("long").alias("seq"), flags.alias("flags"), carried.alias("carried"))
    schema = "key string, first_seq long, last_seq long, kind string, carried string, ts timestamp"
    out = apply(sharded(slim, "key"), ["shard"], Automaton(compiled(steps), within_s * 1000), schema, time_mode="EventTime", event_time="ts")
    out = out.withColumn("key", F.col("key").cast("long"))
    if not own:
        return out.drop("carried")
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*own).dtypes)
    return out.select("key", "first_seq", "last_seq", "kind", "ts", F.from_json("carried", fields).alias("c")).select("key", "first_seq", "last_seq", "kind", "ts", "c.*")
