"""Exact top-k inner products by dual-tree search over cover trees (operator 10)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

TOP, SCALE, EVERY = 5, 256, 50
MOST = 2**63 - 1
#: Vectors of a data shard and of a query block: what one task holds at once. Blocks of one shard that a task takes.
SHARD, QUERY_BLOCK, TOGETHER = 16384, 2048, 8
#: Cells that vectors are dealt to by their nearest centre, at most: so many vectors reach the driver as centres.
CELLS = 1024
#: Points under a node of which it makes no children, and children that a node may have; a node that would need more is a leaf.
LEAF, CHILDREN = 256, 64


class CoverTree:
    """A cover tree built from the top: a node has a point as centre, the points below and the greatest distance to them.

    Covering: each child's points lie within half the node's radius of the child's centre. Separation: the children's
    centres are more than that apart, as they are taken farthest first. Nesting: the first child has the node's own
    centre. A node is a leaf, whose points are compared all at once, if it has LEAF points or fewer or if half its radius
    would take more than CHILDREN centres (in many dimensions that is where nearly every point is a centre of its own).
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.at: list[int] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.root = self._node(np.arange(len(points)), int(((points - points.mean(0)) ** 2).sum(1).argmin()))

    def _node(self, own: np.ndarray, centre: int) -> int:
        me = len(self.centre)
        near = np.sqrt(((self.points[own] - self.points[centre]) ** 2).sum(1))
        radius = float(near.max())
        self.at.append(centre)
        self.centre.append(self.points[centre])
        self.radius.append(radius * (1 + 1e-9) + 1e-9)
        self.members.append(own)
        self.children.append([])
        if len(own) > self.leaf and radius:
            centres, owner = [centre], np.zeros(len(own), int)
            while near.max() > radius / 2 and len(centres) <= CHILDREN:
                far = int(own[near.argmax()])
                away = np.sqrt(((self.points[own] - self.points[far]) ** 2).sum(1))
                closer = away < near
                owner[closer], near[closer] = len(centres), away[closer]
                centres.append(far)
            if len(centres) <= CHILDREN:
                made = [self._node(own[owner == k], c) for k, c in enumerate(centres)]
                self.children[me], self.members[me] = made, None
        return me


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles where every partial sum is below 2^53, whole numbers otherwise."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < 2**53:
        return q @ x.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q], object).reshape(len(q), len(x))


def dual_tree_top(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = TOP, least: float = -np.inf) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, vec_id) of the data but itself, ties to the smaller id.

    Node pairs come best bound first; a pair goes when the highest product its balls allow is below the worst kth
    score of the query group, or than ``least``: products below it may be left out.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    kth = np.full(len(query_ids), least)
    a, b = CoverTree(queries), CoverTree(data)
    centre_a, centre_b = np.array(a.centre), np.array(b.centre)
    radius_a, radius_b = np.array(a.radius), np.array(b.radius)
    norm_a, norm_b = np.linalg.norm(centre_a, axis=1), np.linalg.norm(centre_b, axis=1)
    bound = centre_a @ centre_b.T + norm_a[:, None] * radius_b + radius_a[:, None] * (norm_b + radius_b)
    bound += 1e-6 * (np.abs(bound) + 1)
    below: list[np.ndarray] = [np.empty(0, int)] * len(a.centre)
    for n in range(len(a.centre) - 1, -1, -1):
        below[n] = a.members[n] if a.members[n] is not None else np.concatenate([below[c] for c in a.children[n]])

    todo, n_pairs = [(-bound[a.root, b.root], 0, a.root, b.root)], 1
    while todo:
        negative, _, n, m = heapq.heappop(todo)
        if -negative < kth[below[n]].min():
            continue
        split_a = a.children[n] and (not b.children[m] or a.radius[n] >= b.radius[m])
        if split_a or b.children[m]:
            for x, y in [(c, m) for c in a.children[n]] if split_a else [(n, c) for c in b.children[m]]:
                heapq.heappush(todo, (-bound[x, y], n_pairs, x, y))
                n_pairs += 1
            continue
        rows, columns = below[n], b.members[m]
        scores = _scores(queries[rows], data[columns])
        ids = data_ids[columns]
        hit = scores >= kth[rows][:, None]
        for r in np.flatnonzero(hit.any(1)).tolist():
            i = int(rows[r])
            at = np.flatnonzero(hit[r] & (ids != query_ids[i]))
            if len(at) > 4 * k:  # the k best of many, and all equal to the last of them
                at = at[scores[r][at] >= np.partition(scores[r][at], len(at) - k)[len(at) - k]]
            order = np.lexsort((ids[at], -scores[r][at]))[:k] if scores.dtype != object else range(len(at))
            own = best[i] + [(int(scores[r][at[j]]), int(ids[at[j]])) for j in order]
            own.sort(key=lambda p: (-p[0], p[1]))
            best[i] = own[:k]
            if len(best[i]) == k:
                kth[i] = max(kth[i], best[i][-1][0])
    return best


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors and ids that are null, or components that are null or not
    finite, take no part."""
    ok = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    made = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)
    return made.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale}D * x) as double))").alias("v"))


_PACKED = "part long, cell long, n long, ids binary, v binary, centre array<double>, radius double"


def _packer(dims: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        """One row of a part's vectors, padded to ``dims``, with their ball."""
        v = rows["v"].combine_chunks()
        points = np.zeros((len(rows), dims))
        points[np.arange(dims)[None, :] < v.value_lengths().to_numpy()[:, None]] = v.flatten().to_numpy()
        centre = points.mean(0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(1)).max()) * (1 + 1e-9) + 1e-9
        return pa.table({
            "part": pa.array([rows["part"][0].as_py()], pa.int64()), "cell": pa.array([rows["cell"][0].as_py()], pa.int64()), "n": pa.array([len(rows)], pa.int64()),
            "ids": [rows["vec_id"].to_numpy().tobytes()], "v": [points.tobytes()], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius],
        })

    return pack


def _unpacked(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"], np.float64).reshape(row["n"], dims)


def _parts(rows: DataFrame, size: int, deal: Column) -> DataFrame:
    """``rows`` with a part of ``size`` rows or so, each of one cell; ``deal`` spreads a cell's rows. A row for each cell
    reaches the driver."""
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    first, many = {}, {}
    for cell in sorted(counts):
        first[cell], many[cell] = sum(many.values()), -(-counts[cell] // size)
    pairs = lambda of: F.create_map(*[F.lit(x).cast("long") for item in of.items() for x in item]) if of else F.create_map().cast("map<long,long>")
    return rows.withColumn("part", (F.element_at(pairs(first), F.col("cell")) + F.pmod(F.xxhash64(deal), F.element_at(pairs(many), F.col("cell")))).cast("long"))


def exact_top(vectors: DataFrame, every: int = EVERY, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row whose vec_id ``every`` divides, against every row but itself.

    Vectors of unequal length are compared over the shorter one's components, as if padded with zeros. Rows of a
    repeated vec_id stand for themselves as candidates, except to a query of that id; the query is its least vector. Scores beyond a long are held at its
    limits.

    Vectors are dealt to cells by the nearest of some of them, and cells cut into shards and queries into blocks of a
    bounded size. A block first searches one shard of its own cell; the worst kth score there is its floor. Balls round
    blocks and shards then tell which pairs can reach the floor, and only these are searched, each as one dual-tree
    search, a few blocks of a shard together. The k best of each pair meet by query in a two-step top-k.
    """
    whole = whole_vectors(vectors)
    total, dims = whole.agg(F.count("*"), F.max(F.size("v"))).first()
    dims, cells = max(1, dims or 0), max(1, min(CELLS, -(-total // SHARD)))
    pad = lambda v: np.pad(np.array(v, float), (0, dims - len(v)))
    centres = np.array([pad(r.v) for r in whole.orderBy(F.xxhash64("vec_id"), "v").limit(cells).collect()]).reshape(-1, dims) if cells > 1 else np.zeros((1, dims))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            points = np.zeros((batch.num_rows, dims))
            points[np.arange(dims)[None, :] < v.value_lengths().to_numpy()[:, None]] = v.flatten().to_numpy()
            cell = ((centres**2).sum(1)[None, :] - 2 * (points @ centres.T)).argmin(1)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "v": v, "cell": pa.array(cell, pa.int64())})

    dealt = cut(whole.mapInArrow(to_cells, "vec_id long, v array<double>, cell long"))
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("r")).select("vec_id", "r.v", "r.cell")
    # Equal ids and vectors must not all meet in one shard: rows are dealt by their place, which cut() has fixed.
    shards = cut(_parts(dealt.withColumn("place", F.monotonically_increasing_id()), SHARD, F.col("place")).groupBy("part").applyInArrow(_packer(dims), _PACKED))
    blocks = cut(_parts(asked, QUERY_BLOCK, F.col("vec_id")).groupBy("part").applyInArrow(_packer(dims), _PACKED))
    drop_cut(dealt)

    def floor_of(block: pa.Table, shard: pa.Table) -> pa.Table:
        found = []
        x_ids, x = _unpacked(shard.to_pylist()[0], dims) if len(shard) else (None, None)
        for row in block.to_pylist():
            q_ids, q = _unpacked(row, dims)
            best = dual_tree_top(q, q_ids, x, x_ids, k) if x is not None else []
            least = min((b[k - 1][0] if len(b) == k else -np.inf for b in best), default=-np.inf)
            found.append((row["part"], float(least), row["centre"], row["radius"]))
        names = ("block", "floor", "centre", "radius")
        return pa.table(dict(zip(names, (pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64()))))))

    first = blocks.select(F.col("part").alias("block"), "cell").join(shards.groupBy("cell").agg(F.min("part").alias("part")), "cell").select("block", "part")
    own = first.join(shards.select("part", "n", "ids", "v"), "part").drop("part").withColumnRenamed("block", "part")
    floors = cut(blocks.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(floor_of, "block long, floor double, centre array<double>, radius double"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The (block, shard) pairs of a pack of blocks and a pack of shards whose balls can reach the block's floor."""
        for batch in batches:
            for row in batch.to_pylist():
                get = lambda side, c, row=row: np.array([r[c] for r in row[side]])
                a, b, ra, rb = get("blocks", "centre"), get("shards", "centre"), get("blocks", "radius"), get("shards", "radius")
                bound = a @ b.T + np.linalg.norm(a, axis=1)[:, None] * rb + ra[:, None] * (np.linalg.norm(b, axis=1) + rb)
                i, j = np.nonzero(bound + 1e-6 * (np.abs(bound) + 1) >= get("blocks", "floor")[:, None])
                if len(i):
                    yield pa.record_batch({"block": pa.array(get("blocks", "block")[i], pa.int64()), "shard": pa.array(get("shards", "part")[j], pa.int64())})

    # Packs of a thousand balls on either side: rows of numbers, not of vectors.
    block_packs = floors.groupBy(F.floor(F.col("block") / 1000).alias("pack")).agg(F.collect_list(F.struct("block", "floor", "centre", "radius")).alias("blocks"))
    shard_packs = shards.groupBy(F.floor(F.col("part") / 1000).alias("own")).agg(F.collect_list(F.struct("part", "centre", "radius")).alias("shards"))
    last = blocks.agg(F.max("part")).first()[0] or 0
    shard_packs = shard_packs.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last // 1000).cast("long"))))
    pairs = (block_packs.join(shard_packs, "pack").select("blocks", "shards").mapInArrow(reach, "block long, shard long"))
    turn = cut(pairs.withColumn("turn", F.floor((F.row_number().over(Window.partitionBy("shard").orderBy("block")) - 1) / TOGETHER)))

    def search(block: pa.Table, shard: pa.Table) -> pa.Table:
        x_ids, x = _unpacked(shard.to_pylist()[0], dims)
        found = []
        for row in block.to_pylist():
            q_ids, q = _unpacked(row, dims)
            best = dual_tree_top(q, q_ids, x, x_ids, k, row["floor"])
            found += [(i, v, max(-MOST, min(MOST, s))) for i, own in zip(q_ids.tolist(), best) for s, v in own]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), zip(*found) if found else ((), (), ()))})

    left = blocks.withColumnRenamed("part", "block").join(floors.select("block", "floor"), "block").join(turn, "block").select("shard", "turn", "block", "n", "ids", "v", "floor")
    right = shards.select(F.col("part").alias("shard"), "n", "ids", "v").join(turn.select("shard", "turn").distinct(), "shard")
    right = right.select((F.col("shard") + 0).alias("shard"), (F.col("turn") + 0).alias("turn"), "n", "ids", "v")  # columns of its own
    each = left.groupBy("shard", "turn").cogroup(right.groupBy("shard", "turn")).applyInArrow(search, "query_id long, vec_id long, score long")
    ranked = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "vec_id"))), 1, k).alias("top"))
    out = ranked.select("query_id", F.posexplode("top").alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.n")).alias("score"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_top of embeddings; nulls, repeated ids and an empty table as there."""
    return exact_top(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
