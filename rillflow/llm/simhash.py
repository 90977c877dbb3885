"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 8)."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batches, cut, row_key, table
from .graph import components, link_lists

WORDS_IN_SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def fingerprint(text: str | None, size: int = WORDS_IN_SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; 0 without words (null or empty)."""
    # Only A-Z change case: UTF-8 bytes of other letters are above 0x7F.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER)
    words = _SPACE.sub(b" ", words).strip(b" ")
    if not words:
        return 0
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(words)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < size:
        hashes = [digest(words, SEED)]
    else:
        hashes = [digest(words[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]
    each = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(each), 8192):
        ones += np.unpackbits(each[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(each)).tobytes(), "big")


def covering_positions(positions: int = 8, shared: int = MAX_DISTANCE, width: int = 3) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``shared`` positions contain one.

    For 8, 4 and 3 that is Turan's system: split the positions in three parts, take the triples inside a part and those
    with two in a part and one in the next (20 to 24 of 56); any four positions then contain one of them.
    """
    part = [p * 3 // positions for p in range(positions)]

    def taken(t: tuple[int, ...]) -> bool:
        count = [sum(part[p] == k for p in t) for k in range(3)]
        return max(count) == 3 or any(count[k] == 2 and count[(k + 1) % 3] == 1 for k in range(3))

    out = [t for t in combinations(range(positions), width) if taken(t)]
    assert all(any(set(t) <= set(s) for t in out) for s in combinations(range(positions), shared))
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(key, doc_id, bits) for each row; key is row_key()."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        return pa.record_batch({"key": batch.column("key"), "doc_id": batch.column("doc_id"), "bits": pa.array(bits.view(np.int64))})

    plain = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return by_batches(plain, fn, "key string, doc_id long, bits long")


def simhash_components(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(key, doc_id, bits, root, component_id): the smallest doc_id reachable over links of ``max_distance`` or fewer bits.

    Two fingerprints of at most 4 differing bits share at least 4 of their 8 byte positions, the guaranteed minimum.
    Posting lists of single positional bytes hold 1/256 of the table each, so the inverted index is keyed by position
    triples that any four shared positions must contain. Of each pair that meets in a list the shared positional bytes
    are tallied; only a pair that reaches the minimum is verified by its differing bits. Equal fingerprints are one class, so copies are never paired. Null texts count as empty; rows with
    null doc_id keep a row and never name a component; repeated rows each return; an empty table returns none.
    """
    assert max_distance <= MAX_DISTANCE
    marked = cut(with_fingerprints(docs))
    classes = marked.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    byte = lambda p: F.expr(f"shiftrightunsigned(bits, {8 * p}) & 255")
    keys = F.array(*[
        F.lit(k).cast("long") * (1 << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c)
        for k, (a, b, c) in enumerate(covering_positions())
    ])
    index = classes.select(F.explode(keys).alias("key"), "bits")
    rooted = components(link_lists(index, max_distance, least_shared=8 - max_distance))
    named = cut(classes.join(rooted, F.col("bits") == F.col("node"), "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(least, "root").select("bits", "root", "component_id")
    return marked.join(by_class, "bits").select("key", "doc_id", "bits", "root", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Keep one row of each component, with all its columns: that of smallest doc_id (nulls last), then text digest.

    Of rows with equal doc_id and text one stays: that whose whole row, as text, has the least hash. Null texts count as
    empty; an empty table gives none; columns may have any names.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    kept = simhash_components(docs).groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.key").alias("key"))
    # A struct holds the row, so that no column's name can clash with key.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("key")).join(kept, "key", "left_semi")
    first = Window.partitionBy("key").orderBy(F.xxhash64(F.col("row").cast("string")))
    return held.withColumn("place", F.row_number().over(first)).where("place = 1").select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of documents; nulls, repeated rows and an empty table as in simhash_components."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
