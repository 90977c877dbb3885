"""Spans of several kinds in texts: their digest columns, shared by the secret and the personal-data operator."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind: place in the list of kinds; start and end in code points, end exclusive.
SPAN = "struct<start:int,kind:int,end:int>"
ARROW_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def base_digest(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """SHA-256 of kind:start:end by start, then kind as listed."""
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def spans_text(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    each = F.transform(F.array_sort(F.array_distinct(spans)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")


class Taken:
    """Disjoint stretches of a text, asked by bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.spans: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if self.spans and a < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(b, self.spans[-1][1]))
            else:
                self.spans.append((a, b))

    def meeting(self, start: int, end: int) -> tuple[int, int] | None:
        """The last stretch that overlaps [start, end), if any."""
        at = bisect_left(self.spans, (end, -1)) - 1
        return self.spans[at] if at >= 0 and self.spans[at][1] > start else None

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))
