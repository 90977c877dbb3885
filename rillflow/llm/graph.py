"""Links between fingerprints: exact linking of posting lists, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Members of one posting list that a task links at once; a longer list goes through pairs of chunks.
LIST_LIMIT = 20_000
#: Members, and bytes of their items, of lists that are verified together.
TOGETHER, TOGETHER_BYTES = 8192, 1 << 24
#: Nodes whose links a task joins into stars at once.
CONTRACTED = 500_000

#: Members of a list that are compared with all others at a time where links are judged, and pairs of them.
HEADS, ASKED = 32, 1 << 16

#: What reads an item as (number, marks, what is judged), and what tells of many pairs of the last whether they link. Members
#: of one list have as many marks each.
Verify = tuple[Callable[[str], tuple[int, np.ndarray, object]], Callable[[list, list], np.ndarray]]
#: A distance, or the distance of each key of an array.
Distance = int | Callable[[np.ndarray], np.ndarray]


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """Of each 64-bit difference: how many of its eight byte positions are equal on both sides."""
    return (np.ascontiguousarray(differing).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def spanning_links(bits: np.ndarray, max_distance: int, least_shared: int = 0, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links of a list connect: breadth first, each found member leaves the search.

    Of each pair that meets, the equal byte positions are tallied; a pair with fewer than ``least_shared`` goes. Then
    members link at ``max_distance`` or fewer differing bits. ``side``: only links between members of unequal sides are
    sought (others are linked elsewhere).
    """
    out = []
    rest = np.arange(len(bits))
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            differing = bits[rest] ^ bits[at]
            if least_shared:
                near = shared_bytes(differing) >= least_shared
                near[near] = np.bitwise_count(differing[near]) <= max_distance
            else:
                near = np.bitwise_count(differing) <= max_distance
            if side is not None:
                near &= side[rest] != side[at]
            found = rest[near].tolist()
            out += [(at, i) for i in found]
            frontier += found
            rest = rest[~near]
    return out


def judged_links(
    bits: np.ndarray, max_distance: int, number: np.ndarray, marks: np.ndarray, side: np.ndarray | None = None
) -> Generator[tuple[np.ndarray, np.ndarray], np.ndarray, list[tuple[int, int]]]:
    """Returns links that connect what all links of a list connect, where near members link if the answer to a question holds.

    Members of equal ``number`` are connected already, as are those that links found since then connect: none of them are
    asked about. Nor are pairs with an equal mark, which another list asks about. Members are compared with all later ones,
    some at a time: twice as many after answers that mostly don't hold, one after others, since each of those spares questions.
    """
    out, number = [], np.unique(number, return_inverse=True)[1]
    rest, heads = np.arange(len(bits)), HEADS
    while len(rest) > 1 and (number[rest] != number[rest[0]]).any():
        heads = max(1, min(heads, ASKED // len(rest)))
        own = rest[:heads]
        near = np.bitwise_count(bits[own][:, None] ^ bits[rest]) <= max_distance
        near &= (number[own][:, None] != number[rest]) & (np.arange(len(own))[:, None] < np.arange(len(rest)))
        if side is not None:
            near &= side[own][:, None] != side[rest]
        one, other = (rest[k] for k in np.nonzero(near))
        if marks.shape[1] and len(one):
            fresh = ~(marks[one] == marks[other]).any(1)
            one, other = one[fresh], other[fresh]
        rest, heads = rest[len(own) :], 2 * heads
        if not len(one):
            continue
        ok = yield one, other
        for a, b in zip(one[ok].tolist(), other[ok].tolist()):
            if number[a] != number[b]:
                out.append((a, b))
                number[number == number[b]] = number[a]
        if 2 * ok.sum() > len(ok):
            heads = 1
    return out


def all_links(lists: list[Generator], judged: list[list], judge: Callable[[list, list], np.ndarray]) -> list[list[tuple[int, int]]]:
    """What each of some ``judged_links`` returns; what they ask at a time is judged together."""
    out, turns = [[] for _ in lists], [(k, None) for k in range(len(lists))]
    while turns:
        asking, one, other = [], [], []
        for k, answer in turns:
            try:
                a, b = lists[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
                continue
            asking.append((k, len(one), len(one) + len(a)))
            one += [judged[k][i] for i in a.tolist()]
            other += [judged[k][i] for i in b.tolist()]
        ok = judge(one, other) if asking else None
        turns = [(k, ok[a:b]) for k, a, b in asking]
    return out


def _at(distance: Distance, keys: np.ndarray) -> np.ndarray:
    return distance(keys) if callable(distance) else np.full(len(keys), distance)


def _likely(batches: Iterator[pa.RecordBatch], max_distance: Distance) -> Iterator[pa.RecordBatch]:
    """Sorted batches without most rows that can't link: keys met once, and pairs that are too far apart."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, bits = batch.column("key").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, n))
        drop = sizes == 1
        two = np.flatnonzero(sizes == 2)
        drop[two] = np.bitwise_count(bits[starts[two]] ^ bits[starts[two] + 1]) > _at(max_distance, keys[starts[two]])
        drop[[0, -1]] = False  # these may go on in another batch
        keep = np.repeat(~drop, sizes)
        yield batch if keep.all() else batch.filter(pa.array(keep))


def _short_links(batches: Iterator[pa.RecordBatch], max_distance: Distance, own: str, out: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sorted batches without lists of two or three members; the links ``spanning_links`` gives of these go to ``out``."""
    for batch in batches:
        keys, bits = batch.column("key").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
        ids = batch.column(own).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        short = (sizes == 2) | (sizes == 3)
        short[[0, -1]] = False  # these may go on in another batch
        two, three = starts[short & (sizes == 2)], starts[short & (sizes == 3)]

        def near(at: np.ndarray, i: int, j: int) -> np.ndarray:
            return np.bitwise_count(bits[at + i] ^ bits[at + j]) <= _at(max_distance, keys[at])

        first, second = near(three, 0, 1), near(three, 0, 2)
        for at, i, j, ok in ((two, 0, 1, near(two, 0, 1)), (three, 0, 1, first), (three, 0, 2, second), (three, 1, 2, near(three, 1, 2) & ~(first & second))):
            out.append((ids[at[ok] + i], ids[at[ok] + j]))
        yield batch.filter(pa.array(np.repeat(~short, sizes)))


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, bool]]:
    """Runs of equal key in batches sorted by key, as tables; a run longer than ``limit`` comes in parts flagged True."""
    held: list[pa.RecordBatch] = []
    held_rows, over, now = 0, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != now:
                if held_rows > 1 or held_rows and over:
                    yield pa.Table.from_batches(held), over
                held, held_rows, over, now = [], 0, False, keys[a]
            held.append(batch.slice(a, b - a))
            held_rows += b - a
            if held_rows > limit:
                over = True
                yield pa.Table.from_batches(held), True
                held, held_rows = [], 0
    if held_rows > 1 or held_rows and over:
        yield pa.Table.from_batches(held), over


def link_lists(index: DataFrame, max_distance: Distance, verify: Verify | None = None, limit: int = LIST_LIMIT, least_shared: int = 0) -> DataFrame:
    """Links (a, b) that connect all members of posting lists that are within ``max_distance`` bits.

    ``index`` has key (long), bits (long), id (where it isn't the bits) and, with ``verify``, item. Ids of one list differ. A task holds one list,
    of ``limit`` members at most; a longer one is dealt out anew as pairs of chunks, so no link is lost and no list
    meets in one task; in a pair of unlike chunks only links across are sought. ``least_shared`` is the count filter of
    ``spanning_links``.
    """
    own = "id" if "id" in index.columns else "bits"
    kind = dict(index.dtypes)[own]
    schema = f"a {kind}, b {kind}, key long, bits long" + (", item string" if verify else "")
    columns = schema.replace(",", "").split()[::2]

    def rows(a: list, b: list, like: pa.Schema, deferred: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
        id_type = like.field(own).type
        if deferred is not None:
            n = deferred.num_rows
            arrays = {"a": deferred[own], "b": pa.nulls(n, id_type), "key": deferred["key"], "bits": deferred["bits"]}
            if verify:
                arrays["item"] = deferred["item"]
        else:
            n = len(a)
            arrays = {"a": pa.array(a, id_type), "b": pa.array(b, id_type), "key": pa.nulls(n, pa.int64()), "bits": pa.nulls(n, pa.int64())}
            if verify:
                arrays["item"] = pa.nulls(n, pa.string())
        yield from pa.table({c: arrays[c] for c in columns}).to_batches()

    def linked(groups: list[pa.Table], place: str) -> Iterator[tuple[list, list]]:
        keys = np.array([g[place][0].as_py() for g in groups])
        sides = [g["side"].to_numpy() if "side" in g.column_names else None for g in groups]
        sides = [None if side is None or (side < 0).any() else side for side in sides]
        members = [(g["bits"].to_numpy().view(np.uint64), int(most)) for g, most in zip(groups, _at(max_distance, keys))]
        if verify:
            items = [list(zip(*map(verify[0], g["item"].to_pylist()))) for g in groups]
            lists = [judged_links(*of, np.array(number), np.stack(marks), side) for of, (number, marks, _), side in zip(members, items, sides)]
            found = all_links(lists, [judged for _, _, judged in items], verify[1])
        else:
            found = [spanning_links(*of, least_shared, side) for of, side in zip(members, sides)]
        for group, links in zip(groups, found):
            if links:
                ids = group[own].to_pylist()
                yield [ids[i] for i, _ in links], [ids[j] for _, j in links]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, like, held, members, size = [], [], None, [], 0, 0
        likely, short = _likely(batches, max_distance), []
        if kind == "bigint" and not verify and not least_shared:
            likely = _short_links(likely, max_distance, own, short)
        for group, over in _groups(likely, limit):
            like = group.schema
            if len(short) > 100:  # four a batch
                yield from rows(*map(np.concatenate, zip(*short)), pa.schema([(own, pa.int64())]))
                short.clear()
            if over:
                yield from rows([], [], like, group)
                continue
            held.append(group)
            members += group.num_rows
            size += group["item"].nbytes if verify else 0
            if members >= TOGETHER or size >= TOGETHER_BYTES:
                for x, y in linked(held, "key"):
                    a += x
                    b += y
                held, members, size = [], 0, 0
            if len(a) > 50_000:
                yield from rows(a, b, like)
                a, b = [], []
        for x, y in linked(held, "key") if held else ():
            a += x
            b += y
        if a:
            yield from rows(a, b, like)
        if short:
            yield from rows(*map(np.concatenate, zip(*short)), pa.schema([(own, pa.int64())]))

    first = cut(index.repartition("key").sortWithinPartitions("key").mapInArrow(small, schema))
    links = first.where("key is null").select("a", "b")
    hot = first.where("key is not null").drop("b")
    hot = hot.drop("a") if own == "bits" else hot.withColumnRenamed("a", "id")
    if hot.isEmpty():
        return links
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(limit // 2)).cast("int").alias("chunks"))
    dealt = hot.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(own), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.withColumn("side", F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))).withColumn("pair", F.xxhash64("key", low, high))

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in _groups(batches, 1 << 62):
            for a, b in linked([group], "list"):
                yield from rows(a, b, group.schema)

    more = dealt.select(F.col("pair").alias("key"), F.col("key").alias("list"), "side", *dict.fromkeys((own, "bits")), *(["item"] if verify else []))
    # By number, as few large keys would be put together again.
    more = more.repartition(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return links.unionByName(more.mapInArrow(large, schema).select("a", "b"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a part, some at a time, as stars of their smallest member: what they connect stays connected."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        own = [(x, r) for x, r in pairs if x != r]
        return pa.record_batch({"a": pa.array([x for x, _ in own], pa.int64()), "b": pa.array([r for _, r in own], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        if len(parent) > CONTRACTED:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(links: DataFrame, together: int = CONTRACTED // 2) -> DataFrame:
    """(node, root) of all linked nodes (a, b, as longs) but the roots; root is the smallest node of the component.

    Each task first makes stars of the links it holds. At most ``together`` of these are joined in one task, which then
    holds all their nodes. More of them go through rounds, until they are as few: every node points to its least neighbour, its other
    neighbours are linked to that one, and all pointers skip a node; the rounds grow with the logarithm of the longest
    chain. Each round ends in the shared folder. It is the last when no node has two neighbours below and none that is
    pointed to points on. A null node isn't linked; repeated links count once; no links give no rows.
    """
    now = cut(links.where("a <> b").mapInArrow(_contracted, "a long, b long").distinct())
    while True:
        if now.count() <= together:
            return cut(now.coalesce(1).mapInArrow(_contracted, "a long, b long")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now.select(F.col("a").alias("node"), "b").union(now.select(F.col("b").alias("node"), F.lit(None).cast("long")))
        open_ = seen.groupBy("node").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count_if(F.col("b").isNull()).alias("below"))
        if open_.where("least <> most or least is not null and below > 0").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        met = now.join(least, "a")
        pairs = met.select("a", F.col("m").alias("b")).union(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        skipped = pairs.join(least.select(F.col("a").alias("b"), F.col("m").alias("next")), "b", "left").select("a", F.coalesce("next", "b").alias("b"))
        after = cut(skipped.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        drop_cut(now)
        now = after
