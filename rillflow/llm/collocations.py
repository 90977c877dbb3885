"""Phrase collocations by multikey three-way quicksort of suffix pointers (operator 11)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_of, cut, in_bitmap, table

LEAST, LONGEST, TOP, SCALE = 100, 5, 2000, 1000
#: Suffixes that a leading pair may have before they are dealt to several buckets, that a bucket has on the average, that
#: a task sorts at a time, and that it sends at a time.
ROUTE_ROWS, BUCKET_ROWS, SORT_ROWS, SENT_ROWS = 1 << 20, 1 << 17, 1 << 17, 1 << 16
#: Bytes of text whose words a task holds at a time, up to the next break.
TEXT_BYTES = 1 << 22
SEED = 42
#: Parts of a lang whose best phrases are taken before the lang's.
RANK_PARTS = 16
#: A-Z lower-cased; marks and line ends that part pieces as \n, tabs as blanks.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
_BREAK = b"\n"
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    """(lang, words of its texts in order, with a break between pieces), TEXT_BYTES and the rest of a piece at a time."""
    texts = defaultdict(list)
    for lang, text in zip(batch.column("lang").cast(pa.binary()).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        if text:
            texts[lang].append(text)
    for lang in list(texts):
        flat, at = _BREAK.join(texts.pop(lang)).translate(_BYTES), 0
        while at < len(flat):
            end = flat.find(_BREAK, at + TEXT_BYTES) + 1 or len(flat)
            yield lang, [w for w in flat[at:end].replace(_BREAK, b" \n ").split(b" ") if w]
            at = end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of some words at a time; the empty word has the count of all."""
    for batch in batches:
        for lang, words in _by_lang(batch):
            count = Counter(words)
            breaks = count.pop(_BREAK, 0)
            count[b""] = len(words) - breaks
            yield pa.record_batch({
                "lang": pa.array([lang] * len(count), pa.binary()), "word": pa.array(count.keys(), pa.binary()), "n": pa.array(count.values(), pa.int64()),
            })


class _Numbered:
    """Words of a lang as numbers (0 is a break), their hashes, and which neighbours can both be frequent."""

    def __init__(self, lang: bytes, words: list[bytes], frequent: np.ndarray):
        self.names = [_BREAK, *(set(words) - {_BREAK})]
        number = {w: i for i, w in enumerate(self.names)}
        self.ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        self.hashes = np.array([xxhash.xxh64_intdigest(lang + b"\0" + w, SEED) for w in self.names], np.uint64)
        can = in_bitmap(frequent, self.hashes)
        can[0] = False
        ok = can[self.ids]
        self.linked = ok[:-1] & ok[1:]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        a, b = self.hashes[self.ids[at]], self.hashes[self.ids[at + 1]]
        mixed = a * _MIX[0] + b * _MIX[1]
        return mixed ^ (mixed >> np.uint64(31))


def equal_partitions(keys: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(a row, depth, weight) of each equal partition that weighs ``least`` or more, down to the last column.

    Pointers to the rows of ``keys`` are parted by a pivot of the column at their depth into less, equal and greater;
    equal ones go on with the next column. Parts that weigh less than ``least`` are abandoned, 0 ends a row.
    """
    todo = [(np.arange(len(keys)), 0)] if len(keys) else []
    while todo:
        at, depth = todo.pop()
        column = keys[at, depth]
        pivot = sorted((column[0], column[len(at) // 2], column[-1]))[1]
        equal = at[column == pivot]
        if len(equal) < len(at):
            for side in (at[column < pivot], at[column > pivot]):
                if len(side) and weight[side].sum() >= least:
                    todo.append((side, depth))
        if pivot and (n := int(weight[equal].sum())) >= least:
            yield int(equal[0]), depth, n
            if depth + 1 < keys.shape[1]:
                todo.append((equal, depth + 1))


def _joined(words: pa.Array, size: np.ndarray) -> pa.Array:
    """Runs of so many words, each joined by blanks."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, size.cumsum()), pa.int32()), words), pa.scalar(b" ", pa.binary()))


def _phrases_of(langs: pa.Array, suffixes: pa.Array, weight: np.ndarray, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n) of the equal partitions of two words and more."""
    if not len(suffixes):
        return
    split = pc.split_pattern(suffixes, " ")
    size, flat = pc.list_value_length(split).to_numpy(), split.flatten().dictionary_encode()
    number = flat.indices.to_numpy()
    keys = np.zeros((len(suffixes), longest + 1), np.int32)
    keys[:, 0] = langs.dictionary_encode().indices.to_numpy() + 1
    keys[:, 1:][np.arange(longest) < size[:, None]] = number + 1
    found = [(row, depth, n) for row, depth, n in equal_partitions(keys, weight, least) if depth > 1]
    for k in range(0, len(found), SENT_ROWS):
        row, depth, n = (np.array(c) for c in zip(*found[k : k + SENT_ROWS]))
        words = keys[row, 1:]
        yield pa.record_batch({
            "lang": langs.take(pa.array(row)), "phrase": _joined(flat.dictionary.take(pa.array(words[np.arange(longest) < depth[:, None]] - 1)), depth),
            "words": pa.array(depth, pa.int32()), "n": pa.array(n, pa.int64()),
        })


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, route_rows: int = ROUTE_ROWS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of words and phrases of up to ``longest`` words that occur ``least`` times or more,
    (lang, n) of all words), as written tables; lang and phrase are bytes.

    Words are counted first, then pairs by hash; both only tell which suffixes can lead to a frequent phrase (bitmaps of
    fixed size, which let too many through but none too few). A suffix pointer stands for up to ``longest`` words
    from a place, as far as neighbours can be frequent; equal ones of TEXT_BYTES are one with a weight. They are routed by
    their two leading words, in packets of such suffixes for one bucket of pairs; buckets are as many as the rows
    ask for. A pair with more than ``route_rows`` is dealt to several buckets by the whole suffix, and their counts are
    added. The buckets are sorted by ``equal_partitions``, some at a time.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = given.mapInArrow(_words, "lang binary, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut(words.where((F.col("n") >= least) | (F.length("word") == 0)))
    totals, words = words.where("length(word) = 0").select("lang", "n"), words.where("length(word) > 0")
    hashed = words.select(F.xxhash64(F.concat("lang", F.lit(b"\0"), "word")).alias("own"))
    frequent = spark.sparkContext.broadcast(bitmap_of(hashed, "own"))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in _by_lang(batch):
                text = _Numbered(lang, own, frequent.value)
                pair, n = np.unique(text.pairs(np.flatnonzero(text.linked)), return_counts=True)
                yield pa.record_batch({"pair": pa.array(pair.view(np.int64)), "n": pa.array(n, pa.int64())})

    pairs = cut(given.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    most, total = (v or 0 for v in pairs.agg(F.max("n"), F.sum("n")).first())
    salts = np.uint64(max(1, -(-most // route_rows)))
    buckets = np.uint64(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS)))
    leading = spark.sparkContext.broadcast((bitmap_of(pairs, "pair"), bitmap_of(pairs.where(F.col("n") > route_rows), "pair")))

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, large = leading.value
        for batch in batches:
            for lang, own in _by_lang(batch):
                text = _Numbered(lang, own, frequent.value)
                at = np.flatnonzero(text.linked)
                can = np.zeros(len(own) + longest, bool)
                can[at] = in_bitmap(lead, text.pairs(at))
                at = np.flatnonzero(can)
                ids = np.zeros((len(at), longest), np.int32)
                ids[:, 0], ids[:, 1] = text.ids[at], text.ids[at + 1]
                on = np.ones(len(at), bool)
                for k in range(2, longest):
                    on &= can[at + k - 1]
                    ids[on, k] = text.ids[at[on] + k]
                code = ids[:, 0].astype(np.int64)
                for k in range(1, longest):
                    _, first, code, n = np.unique(code * len(text.names) + ids[:, k], return_index=True, return_inverse=True, return_counts=True)
                if not len(at):
                    continue
                ids, at = ids[first], at[first]
                route = text.pairs(at)
                hot = in_bitmap(large, route)
                whole = route.copy()
                for k in range(2, longest):
                    whole = (whole ^ (whole >> np.uint64(29))) * _MIX[2] + text.hashes[ids[:, k]]
                route = np.where(hot, (route + (whole >> np.uint64(7)) % salts + np.uint64(1)) * _MIX[0], route)
                bucket = ((route >> np.uint64(11)) % buckets).astype(np.int64)
                order = np.lexsort((hot, bucket))
                bucket, hot = bucket[order], hot[order]
                starts = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (hot[1:] != hot[:-1])])
                starts[::SENT_ROWS] = True  # packets end where a batch does
                names, n = pa.array(text.names, pa.binary()), n[order]
                for k in range(0, len(order), SENT_ROWS):
                    rows = ids[order[k : k + SENT_ROWS]]
                    begin = np.flatnonzero(starts[k : k + SENT_ROWS])
                    edges = pa.array(np.append(begin, len(rows)), pa.int32())
                    suffixes = _joined(names.take(pa.array(rows[rows > 0])), (rows > 0).sum(1))
                    yield pa.record_batch({
                        "bucket": pa.array(bucket[k + begin]), "hot": pa.array(hot[k + begin]), "lang": pa.array([lang] * len(begin), pa.binary()),
                        "suffixes": pa.ListArray.from_arrays(edges, suffixes), "n": pa.ListArray.from_arrays(edges, pa.array(n[k : k + SENT_ROWS], pa.int64())),
                    })

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for hot in (False, True):
                own = rows.filter(pc.equal(rows["hot"], hot)).combine_chunks()
                langs = own["lang"].take(pc.list_parent_indices(own["suffixes"])).combine_chunks()
                suffixes, weight = pc.list_flatten(own["suffixes"]).combine_chunks(), pc.list_flatten(own["n"]).to_numpy()
                yield from _phrases_of(langs, suffixes, weight, 1 if hot else least, longest)

        for batch in batches:
            held.append(batch)
            if sum(len(b.column("suffixes").flatten()) for b in held) >= SORT_ROWS:
                rows = pa.Table.from_batches(held)
                bucket = rows["bucket"].to_numpy()
                end = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                yield from flush(rows[:end])
                held = rows[end:].to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    packets = given.mapInArrow(point, "bucket long, hot boolean, lang binary, suffixes array<binary>, n array<long>")
    routed = packets.repartition("bucket").sortWithinPartitions("bucket")
    counted = routed.mapInArrow(sort, "lang binary, phrase binary, words int, n long")
    phrases = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    one = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    return cut(phrases.unionByName(one)), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases by the score of their weakest cut.

    A phrase inside a longer one as frequent as itself is dropped: such a phrase also lies inside one that is a word
    longer and as frequent, so only those are asked. Null and empty texts have no words, a null lang is ``und``,
    repeated rows count each time, texts of any length are read whole, ties go by score, a, then phrase; an empty table,
    or one without a frequent phrase, gives no row; other columns than lang and text aren't read.
    """
    counts, totals = phrase_counts(docs, least, longest, route_rows)
    counts = counts.select(F.col("lang").cast("string"), F.col("phrase").cast("string"), "words", F.col("n").alias("a"))
    totals = totals.select(F.col("lang").cast("string"), "n")
    parts = F.split("phrase", " ")
    several = counts.where("words > 1")
    inner = F.array(F.array_join(F.slice(parts, 1, F.col("words") - 1), " "), F.array_join(F.slice(parts, 2, F.col("words") - 1), " "))
    covered = several.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").distinct()
    kept = several.join(covered, ["lang", "phrase", "a"], "left_anti").join(totals, "lang")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    join = lambda a, b: F.array_join(F.slice(parts, a, b), " ")
    cuts = cuts.select("*", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    lefts, rights = (counts.select("lang", F.col("phrase").alias(p), F.col("a").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({SCALE} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    scored = cuts.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``collocations`` of documents; nulls, empty and long texts, ties, repeated rows and empty tables as there."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM lists GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS (SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS m FROM starts),
f AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE m > 1),
kept AS (
  SELECT c.* FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, m, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n, k,
    CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts JOIN totals USING (lang)
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1 : k], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[k + 1 : cuts.m], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""
