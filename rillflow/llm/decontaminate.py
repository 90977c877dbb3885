"""Benchmark decontamination with suffix arrays of the training shards (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, row_key, table

WINDOW = 13
#: Words of a shard whose suffixes are sorted together, and bytes of benchmark text that are broadcast at once.
SHARD_WORDS, BLOCK_BYTES = 1_000_000, 8 << 20
#: 20 * n_hit >= n_words makes a document contaminated.
SHARE = 20
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased; letters beyond ASCII belong to words, so UTF-8 bytes can be split as they are."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class TestSuffixes:
    """Every window of the benchmark items of one block, as big-endian word numbers (0 is any other word)."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.window = window
        windows: dict[int, dict[tuple[int, ...], list[tuple[int | None, int]]]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1) if size else ():
                windows.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), []).append((item_id, at))
        self.sizes = sorted(windows)
        self.keys = {n: np.array(list(w), ">u4").reshape(-1, n) for n, w in windows.items()}
        self.owners = {n: list(w.values()) for n, w in windows.items()}


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.dtype.itemsize * rows.shape[1]}").ravel()


def shard_matches(ids: np.ndarray, tests: TestSuffixes) -> Iterator[tuple[int, int, list[tuple[int | None, int]]]]:
    """(position, size, [(item id, word of the item)]) of each window occurrence in a shard; 0 in ``ids`` ends a document or is a foreign word.

    The shard's suffix array is built over the first ``window`` words, and only over suffixes that can match: those
    whose words are all the benchmark's for as long as its shortest window. Each test suffix is then searched by bisection.
    """
    if not tests.sizes or not len(ids):
        return
    n = len(ids)
    zeros = np.flatnonzero(np.append(ids, 0) == 0)
    run = zeros[np.searchsorted(zeros, np.arange(n))] - np.arange(n)
    at = np.flatnonzero(run >= tests.sizes[0])
    if not len(at):
        return
    padded = np.concatenate([ids, np.zeros(tests.window, ids.dtype)]).astype(">u4")
    suffixes = padded[at[:, None] + np.arange(tests.window)[None, :]]
    length = np.minimum(run[at], tests.window)
    suffixes[np.arange(tests.window)[None, :] >= length[:, None]] = 0
    keys = _as_bytes(suffixes)
    array = np.argsort(keys, kind="stable")
    keys, at = keys[array], at[array]
    for size in tests.sizes:
        wide = np.zeros((len(tests.keys[size]), tests.window), ">u4")
        wide[:, :size] = tests.keys[size]
        low = np.searchsorted(keys, _as_bytes(wide), "left")
        wide[:, size:] = 0xFFFFFFFF
        high = np.searchsorted(keys, _as_bytes(wide), "right")
        for k in np.flatnonzero(high > low).tolist():
            for position in at[low[k] : high[k]].tolist():
                yield position, size, tests.owners[size][k]


def _shards(batches: Iterator[pa.RecordBatch], tests: TestSuffixes) -> Iterator[tuple[list, list[int], np.ndarray, np.ndarray]]:
    """(rows, word counts, starts, ids) of shards of about SHARD_WORDS words; documents end with a 0."""
    rows, counts, parts, total = [], [], [], 0
    get = tests.vocabulary.get

    def done():
        starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)[:-1]]).astype(np.int64)
        return rows, counts, starts, np.concatenate(parts)

    for batch in batches:
        for key, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ids = [get(w, 0) for w in words_of(text.as_py())]
            rows.append((key, doc_id))
            counts.append(len(ids))
            ids.append(0)
            parts.append(np.array(ids, np.uint32))
            total += len(ids)
            if total > SHARD_WORDS:
                yield done()
                rows, counts, parts, total = [], [], [], 0
    if rows:
        yield done()


HITS = "key string, doc_id long, n_words long, hits array<int>, items array<string>, matches array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"
_MATCH = pa.struct([("item_id", pa.string()), *[(n, pa.int32()) for n in ("doc_word", "item_word", "n_words")]])


def longest(found: set[tuple[str, int, int]], size: dict[str, int]) -> list[dict]:
    """Of window occurrences (item, word of the document, word of the item): the longest verbatim match of each item.

    Occurrences on one diagonal whose document words follow each other are one longer match; ties go to the first place.
    """
    best: dict[str, tuple[int, int, int]] = {}
    start, before = None, None
    for item, gap, word in sorted((i, d - w, d) for i, d, w in found):
        if before != (item, gap, word - 1):
            start = word
        before = (item, gap, word)
        n = word - start + size[item]
        if item not in best or (-n, start) < (-best[item][2], best[item][0]):
            best[item] = (start, start - gap, n)
    return [dict(zip(("item_id", "doc_word", "item_word", "n_words"), (i, *b))) for i, b in sorted(best.items())]


def _hits(docs: DataFrame, tests: TestSuffixes) -> DataFrame:
    """A row for each document row: the maximal runs of hit words as [start, end, start, ...] and the items met."""
    sent = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, starts, ids in _shards(batches, sent.value):
            spans: dict[int, list[tuple[int, int]]] = {}
            met: dict[int, set[tuple[str, int, int]]] = {}
            sizes: dict[str, int] = {}
            found = list(shard_matches(ids, sent.value))
            owners = np.searchsorted(starts, [p for p, _, _ in found], "right") - 1
            for d, (position, size, own) in zip(owners.tolist(), found):
                spans.setdefault(d, []).append((position - int(starts[d]), position - int(starts[d]) + size))
                named = [(str(i), w) for i, w in own if i is not None]
                sizes.update((i, size) for i, _ in named)
                met.setdefault(d, set()).update((i, position - int(starts[d]), w) for i, w in named)
            matches = [longest(met.get(d, set()), sizes) for d in range(len(rows))]
            yield pa.record_batch({
                "key": pa.array([k for k, _ in rows], pa.string()),
                "doc_id": pa.array([i for _, i in rows], pa.int64()),
                "n_words": pa.array(counts, pa.int64()),
                "hits": pa.array([merged(spans.get(d, ())) for d in range(len(rows))], pa.list_(pa.int32())),
                "items": pa.array([[m["item_id"] for m in own] for own in matches], pa.list_(pa.string())),
                "matches": pa.array(matches, pa.list_(_MATCH)),
            })

    out = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HITS)
    out._sent = sent
    return out


def merged(spans) -> list[int]:
    """Overlapping or touching (start, end) as one, flattened."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[TestSuffixes]:
    """The benchmark as blocks of about ``block_bytes`` of text, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield TestSuffixes([tuple(r) for r in own.collect()])


def overlaps(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, doc_id, n_words, hits, items, matches) for each document row: hit word runs, the items whose windows occur,
    and the longest verbatim match of each with its places in the document and in the item.

    A benchmark beyond ``block_bytes`` is searched block by block, each against all documents. Null texts have no
    words; an item without an id makes hits but isn't named; an item without words has no window. Repeated document rows
    each return; of repeated item ids all texts count; an empty table of documents gives no row.
    """
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _hits(docs, first)
    # Each block is searched and its result written before the driver makes the next: two of them are held at most.
    parts = []
    for tests in chain((first, second), blocks):
        found = _hits(docs, tests)
        parts.append(cut(found))
        found._sent.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [merged([(a, b) for h in own for a, b in zip(h[::2], h[1::2])]) for own in batch.column("hits").to_pylist()]
            yield pa.record_batch({c: batch.column(c) if c != "hits" else pa.array(hits, pa.list_(pa.int32())) for c in batch.schema.names})

    # Equal rows have equal hits: one row of each key, and as many as there are of it.
    every = every.groupBy("key", "doc_id", "n_words").agg(
        F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"),
        (F.count("*") / len(parts)).cast("int").alias("times"),
    )
    every = every.mapInArrow(merge, HITS + ", times int")
    return every.withColumn("__t", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("__t", "times")


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): each document's longest verbatim match with each item it meets.

    Null and empty texts meet none, items without an id aren't listed, repeated rows each return their matches.
    """
    return overlaps(docs, benchmark).select("doc_id", F.inline("matches")).withColumn("item_id", F.col("item_id").cast("long"))


def judged(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(transform(hits, (x, k) -> if(k % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return found.select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept, whatever their names.

    Null and empty texts have no words and stay; repeated rows are judged alike; an empty table of either kind removes
    nothing.
    """
    own = free_name(docs)
    bad = judged(overlaps(docs, benchmark)).where("contaminated").select(F.col("key").alias(own)).distinct()
    return docs.withColumn(own, row_key()).join(bad, own, "left_anti").drop(own)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of documents; nulls, repeated rows and
    empty tables as in overlaps."""
    return judged(overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("key")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
m AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, gram)),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
