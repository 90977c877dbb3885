"""Removal of repeated 100-byte strings with longest-previous-factor arrays (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_of, cut, in_bitmap, table

#: Length of a repeated string, and of the grams whose minimum anchors it.
LENGTH, GRAM = 100, 24
#: Grams of a string of LENGTH bytes: the least of them is its anchor.
GRAMS = LENGTH - GRAM + 1
#: Bytes of text that are hashed together.
CHUNK = 1 << 19
#: Contexts that a task sorts at once (a gram with more is sorted an offset from its anchor at a time), and contexts of
#: one gram that a task holds; still more are dealt anew by their strings.
CONTEXT_LIMIT, GRAM_LIMIT = 4000, 100_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram of GRAM bytes: a polynomial built by doubling, then mixed."""
    have, h, at, n = 1, data.astype(np.uint64) + _U(1), 0, GRAM
    out = np.zeros(max(len(data) - GRAM + 1, 0), np.uint64)
    while n:
        power = _U(pow(_BASE, have, 1 << 64))
        if n & 1:
            out = out * power + h[at : at + len(out)]
            at += have
        n >>= 1
        if n:
            h = h[:-have] * power + h[have:]
            have *= 2
    out = (out ^ out >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return out ^ out >> _U(29)


def anchors_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, first, last, gram hash) of each anchor of texts laid end to end.

    The strings of LENGTH bytes that start from ``first`` to ``last`` have their least gram (the leftmost of equals) at
    that position. Which gram that is depends on the string alone, so equal strings have equal anchors in equal places.
    """
    starts = len(data) - LENGTH + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    h = gram_hashes(data)
    place_mask = _U((1 << 20) - 1)
    least, width = (h & ~place_mask) | np.arange(len(h), dtype=np.uint64), 1
    while width < GRAMS:
        step = min(width, GRAMS - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    place = (least[:starts] & place_mask).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(starts), "right")
    inside = np.arange(starts) + LENGTH <= ends[owner]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [starts]]) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    at = place[first]
    return owner[first], at, first, last, h[at]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _spot(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's place in its text and the strings it stands for, in one number that sorts by place."""
    return at << 14 | (at - first) << 7 | (last - first)


def _stretch(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings of an anchor."""
    first = (spot >> 14) - (spot >> 7 & 127)
    return first, first + (spot & 127)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc, tie, text bytes, offset in the text, anchors) of texts, CHUNK bytes or so at once; a longer text comes in
    chunks that overlap, so that each of its strings lies in one."""

    def done(held: list[tuple]) -> tuple:
        data = b"".join(h[2] for h in held)
        ends = np.cumsum([len(h[2]) for h in held])
        owner, at, first, last, gram = anchors_of(np.frombuffer(data, np.uint8), ends)
        begin = np.array([e - len(h[2]) - h[3] for e, h in zip(ends.tolist(), held)], np.int64)[owner]
        doc, tie = (np.array([h[k] for h in held], np.int64)[owner] for k in (0, 1))
        return data, doc, tie, at, first, last, gram, begin

    held, size = [], 0
    for batch in batches:
        for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if len(data) < LENGTH:
                continue
            for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
                part = data[at : at + CHUNK + LENGTH - 1]
                if held and size + len(part) > CHUNK:
                    yield done(held)
                    held, size = [], 0
                held.append((doc, tie, part, at))
                size += len(part)
    if held:
        yield done(held)


ANCHORS = "gram long, context long, doc long, tie long, spot long, known boolean"


def anchored(docs: DataFrame) -> DataFrame:
    """(gram, context, doc, tie, spot, known) of all anchors. context is a hash of all bytes that the anchor's strings
    cover; known: an earlier anchor of this chunk has the same gram and context, so its strings all occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for data, doc, tie, at, first, last, gram, begin in _chunks(batches):
            context = np.array([digest(data[a : b + LENGTH], p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist())], np.uint64)
            spot = _spot(at - begin, first - begin, last - begin)
            order = np.lexsort((spot, tie, doc, context, gram))
            g, c = gram[order], context[order]
            same = np.concatenate([[False], (g[1:] == g[:-1]) & (c[1:] == c[:-1])])
            # Places rise within a context; equal ones (rows that repeat) share a rank, so that neither is earlier.
            place = np.stack([doc[order], tie[order], spot[order]], 1)
            rank = np.concatenate([[0], np.cumsum(~same[1:] | (place[1:] != place[:-1]).any(1))])
            known = previous_factors(np.where(same, LENGTH, 0), rank) >= LENGTH
            yield pa.record_batch({
                "gram": _signed(g), "context": _signed(c), "doc": pa.array(doc[order]), "tie": pa.array(tie[order]),
                "spot": pa.array(spot[order]), "known": pa.array(known),
            })

    return docs.mapInArrow(run, ANCHORS)


JUDGED = "gram long, doc long, tie long, spot long, several boolean"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by gram, context, doc, tie and spot: those whose strings all occur earlier, and, with several
    set, the first of each context where a gram has several contexts. Holds two rows between batches."""
    names = ["gram", "doc", "tie", "spot"]
    gram = context = lead = lone = None  # lead: of the context; lone: of a gram that has had one context so far

    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column("known").to_numpy(zero_copy_only=False)
        every = [batch.column(k).to_numpy() for k in names]
        rows = [[x[known] for x in every], [x[~known] for x in every]]
        marks = [np.zeros(known.sum(), bool), np.zeros(0, bool)]
        if len(rows[1][0]):
            g, c = rows[1][0], batch.column("context").to_numpy()[~known]
            place = np.stack(rows[1][1:], 1)
            new_gram = np.concatenate([[gram is None or g[0] != gram], g[1:] != g[:-1]])
            new = new_gram | np.concatenate([[context is None or c[0] != context], c[1:] != c[:-1]])
            own = np.cumsum(new)
            leads = np.concatenate([[lead if lead is not None else (0, 0, 0)], place[new]])[own]
            # The first of a context that an earlier batch began stands before this batch's rows, in suffix order too.
            every_place = np.concatenate([leads[:1], place])
            same = np.concatenate([[False], ~new])
            rank = np.concatenate([[0], np.cumsum(~same[1:] | (every_place[1:] != every_place[:-1]).any(1))])
            later = previous_factors(np.where(same, LENGTH, 0), rank)[1:] >= LENGTH
            run = np.cumsum(new_gram)  # 0: the gram carried over
            count = np.bincount(run, new, run[-1] + 1)
            if run[0] == 0:
                count[0] += 1 if lone is not None else 2
            several = new & (count[run] > 1)
            keep = later | several
            rows[1], marks[1] = [x[keep] for x in rows[1]], several[keep]
            if run[0] == 0 and lone is not None and count[0] > 1:
                rows.append([np.array([x]) for x in lone])
                marks.append(np.array([True]))
                lone = None
            if run[-1] > 0:
                at = np.flatnonzero(new_gram)[-1]
                lone = (g[at], *place[at]) if count[-1] == 1 else None
            gram, context, lead = g[-1], c[-1], leads[-1]
        out = [np.concatenate(x) for x in zip(*rows)]
        yield pa.record_batch([*map(pa.array, out), pa.array(np.concatenate(marks))], names=[*names, "several"])


def identity(gram: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> np.ndarray:
    mixed = (gram.astype(np.uint64) ^ doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) + spot.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> _U(31)


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch({"own": _signed(identity(*(batch.column(k).to_numpy() for k in ("gram", "doc", "spot"))))})


CONTEXTS = "gram long, doc long, tie long, at long, first long, bytes binary"


def contexts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The bytes that the strings of an anchor cover, for anchors in the bitmap. A row let through by chance is one more
    true occurrence and changes no result."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, doc, tie, at, first, last, gram, begin in _chunks(batches):
            hit = np.flatnonzero(in_bitmap(sent.value, identity(gram, doc, _spot(at - begin, first - begin, last - begin))))
            if len(hit):
                yield pa.record_batch({
                    "gram": _signed(gram[hit]), "doc": pa.array(doc[hit]), "tie": pa.array(tie[hit]), "at": pa.array((at - begin)[hit]), "first": pa.array((first - begin)[hit]),
                    "bytes": pa.array([data[a : b + LENGTH] for a, b in zip(first[hit].tolist(), last[hit].tolist())], pa.binary()),
                })

    return docs.mapInArrow(run, CONTEXTS)


def previous_factors(common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The longest prefix that each entry of a suffix order shares with one of smaller rank.

    ``common``: the prefix that an entry shares with the one before it. On either side the nearest entry of smaller rank
    (previous and next smaller value) is found by jumps: what lies between an entry and its candidate ranks no less, so a
    candidate that isn't smaller hands over its own.
    """
    n = len(rank)
    out = np.zeros(n, np.int64)
    for side in (1, -1):
        r = rank[::side]
        reach = np.zeros(n, np.int64)
        reach[1:] = common[1:] if side == 1 else common[:0:-1]
        to = np.arange(-1, n - 1)
        todo = np.flatnonzero((to >= 0) & (reach > 0))
        while len(todo):
            at = to[todo]
            todo = todo[r[at] >= r[todo]]
            if len(todo):
                at = to[todo]
                reach[todo], to[todo] = np.minimum(reach[todo], reach[at]), to[at]
                todo = todo[(to[todo] >= 0) & (reach[todo] > 0)]
        reach[to < 0] = 0
        out = np.maximum(out, reach[::side])
    return out


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, rank: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """For the suffixes of ``text`` at ``starts``: the longest prefix, up to ``limit`` bytes, that a suffix of smaller rank
    shares with it. The suffixes are sorted by their first ``limit`` bytes, equal ones by rank."""
    if not len(starts):
        return np.zeros(0, np.int64)
    rows = text[starts[:, None] + np.arange(limit)[None, :]]
    keys = np.concatenate([rows, rank.astype(">u8").view(np.uint8).reshape(-1, 8)], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{limit + 8}").ravel(), kind="stable")
    rows, n = rows[order], len(order)
    differ = rows[1:] != rows[:-1]
    common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), limit)])
    out = np.empty(n, np.int64)
    out[order] = previous_factors(common, rank[order])
    return out


FOUND = "doc long, tie long, start long, end long, bytes binary"


def _found(doc, tie, start, end, data=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.record_batch({
        "doc": pa.array(doc, pa.int64()), "tie": pa.array(tie, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()),
        "bytes": pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary()),
    })


def _windows(t: pa.Table, offsets: tuple[int, int] = (0, GRAMS)) -> tuple[np.ndarray, ...]:
    """(text, place in the text, doc, tie, start) of the strings of the contexts that start so many bytes before their
    anchor (from, below); equal rows count once."""
    key = np.stack([t[k].to_numpy() for k in ("gram", "doc", "tie", "first")], 1)
    t = t.take(pa.array(np.unique(key, axis=0, return_index=True)[1]))
    data = t["bytes"].to_pylist()
    sizes = np.array([len(b) for b in data])
    text = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum(sizes) - sizes
    lead = t["at"].to_numpy() - t["first"].to_numpy()
    low = np.maximum(lead - offsets[1] + 1, 0)
    n = np.maximum(np.minimum(lead - offsets[0], sizes - LENGTH) - low + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner]
    doc, tie, first = (t[k].to_numpy()[owner] for k in ("doc", "tie", "first"))
    return text, begin[owner] + within, doc, tie, first + within


def _factors(limit: int, gram_limit: int):
    def solved(held: list[pa.Table], offsets: tuple[int, int] = (0, GRAMS)) -> pa.RecordBatch:
        text, at, doc, tie, start = _windows(pa.concat_tables(held), offsets)
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((start, tie, doc))] = np.arange(len(at))
        hit = np.flatnonzero(longest_previous_factors(text, at, rank) >= LENGTH)
        hit = hit[np.lexsort((start[hit], tie[hit], doc[hit]))]
        d, t, s = doc[hit], tie[hit], start[hit]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)])[: len(hit)]
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(hit)]])[: len(first)] - 1
        return _found(d[first], t[first], s[first], s[last] + LENGTH)

    def strings(group: pa.Table) -> Iterator[pa.RecordBatch]:
        for k in range(0, group.num_rows, 500):
            text, at, doc, tie, start = _windows(group.slice(k, 500))
            raw = text.tobytes()
            yield _found(doc, tie, start, start + LENGTH, [raw[a : a + LENGTH] for a in at.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of repeated strings, a suffix array for some whole grams at a time. Strings at unequal offsets from an
        anchor are never equal, so a gram of many contexts takes one for some offsets at a time. Contexts of a gram that has
        more than ``gram_limit`` come out as their strings, to be dealt anew. Batches are sorted by gram."""
        held: list[pa.Table] = []
        group: list[pa.Table] = []
        rows, size, now = 0, 0, None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if size > gram_limit:
                for g in group:
                    yield from strings(g)
            elif size > limit:
                step = max(1, limit * GRAMS // (2 * size))
                for low in range(0, GRAMS, step):
                    yield solved(group, (low, low + step))
            elif size > 1:
                held.extend(group)
                rows += size

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            for a, b in zip(cuts, cuts[1:]):
                if gram[a] != now:
                    yield from closed()
                    group, size, now = [], 0, gram[a]
                    if rows > limit // 2:
                        yield solved(held)
                        held, rows = [], 0
                size += b - a
                group.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                if size > gram_limit:
                    for g in group:
                        yield from strings(g)
                    group = []
        yield from closed()
        if held:
            yield solved(held)

    return run


def repeated(docs: DataFrame, limit: int = CONTEXT_LIMIT, gram_limit: int = GRAM_LIMIT) -> DataFrame:
    """(doc, tie, start, end): stretches of each text covered by strings of LENGTH bytes that also start earlier."""
    judged = anchored(docs).withColumn("deal", F.when(F.col("known"), F.xxhash64("doc", "spot")).otherwise(F.col("gram")))
    judged = judged.repartition("deal").sortWithinPartitions("gram", "context", "doc", "tie", "spot").drop("deal")
    judged = cut(judged.mapInArrow(_judge, JUDGED))
    leads = judged.where("several").mapInArrow(_identities, "own long")
    met = contexts(docs, bitmap_of(leads, "own")).repartition("gram").sortWithinPartitions("gram", "doc", "tie", "first")
    found = cut(met.mapInArrow(_factors(limit, gram_limit), FOUND))
    split = found.where("bytes is not null")
    later = judged.where("not several").select("doc", "tie", *_spot_columns())
    out = later.unionByName(found.where("bytes is null").drop("bytes"))
    if not split.isEmpty():
        earlier = Window.partitionBy("bytes").orderBy("doc", "tie", "start")
        lone = split.dropDuplicates(["doc", "tie", "start"])
        out = out.unionByName(lone.withColumn("n", F.row_number().over(earlier)).where("n > 1").select("doc", "tie", "start", "end"))
    return out


def _spot_columns() -> list[F.Column]:
    first = F.expr("shiftright(spot, 14) - (shiftright(spot, 7) & 127)")
    return [first.alias("start"), (first + F.expr(f"(spot & 127) + {LENGTH}")).alias("end")]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kept_texts = [], []
        for doc_id, text, starts, ends in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("starts"), batch.column("ends")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            spans = 0
            kept, removed = data, 0
            if starts.is_valid and len(starts.values):
                a, b = np.sort(starts.values.to_numpy()), np.sort(ends.values.to_numpy())
                # Of stretches sorted by start and by end, a maximal run begins where all before have ended.
                new = np.concatenate([[True], a[1:] > b[:-1]])
                a, b = a[new], b[np.concatenate([new[1:], [True]])]
                spans, removed = len(a), int((b - a).sum())
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
            rows.append((doc_id, len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
            kept_texts.append(kept.decode("utf-8", "replace") if removed else text.as_py())
        types = [pa.int64()] * 4 + [pa.string()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        yield pa.record_batch([*(pa.array(v, t) for v, t in zip(zip(*rows), types)), pa.array(kept_texts, pa.string())], names=names)


def remove_repeats(docs: DataFrame, limit: int = CONTEXT_LIMIT, gram_limit: int = GRAM_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of each row; text is what is left (a character that lost
    some of its bytes is replaced there; the digest is of the bytes).

    Earlier means a smaller doc_id or the same document and an earlier start. Null texts are empty; null doc_ids come
    last; rows of one doc_id and unequal texts are ordered by a digest of the text, equal rows count as one document and
    get the same result. Grams are compared as 64-bit hashes, and so are contexts; strings of unequal contexts by bytes.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie"), F.col("text").cast("string").alias("text"),
    )
    stretches = repeated(own.select("doc", "tie", "text"), limit, gram_limit).groupBy("doc", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = own.join(stretches, ["doc", "tie"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_apply, RESULT)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of documents; nulls, repeated rows and an empty table as in remove_repeats."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("text")
