"""Merkle manifest of a dataset as a postorder append log (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Levels that one aligned builder closes: it holds FANOUT ** LEVELS nodes of its lowest level at most.
LEVELS = 4
#: A node of the log; ``n`` is the number of the tree's leaves, name, doc_id and claimed are a leaf's own.
NODE = "tree string, level int, idx long, pos long, digest string, n long, top boolean, name string, doc_id long, claimed string"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def size_at(n: int, level: int) -> int:
    """Nodes of a level of a tree with n leaves."""
    return -(-n >> FANOUT_BITS * level)


def positions(level: int, idx: np.ndarray, n: int) -> np.ndarray:
    """Places of nodes ``idx`` of a level in the postorder of a tree with n leaves, from 0.

    Before a node stand the nodes of its own level and below up to its last leaf, but itself, and of each level above
    those that are complete before its first leaf.
    """
    idx = np.asarray(idx, np.int64)
    end = np.minimum((idx + 1) << FANOUT_BITS * level, n)
    out = np.full(idx.shape, -1, np.int64)
    for i in range(level + 1):
        out += (end + (1 << FANOUT_BITS * i) - 1) >> FANOUT_BITS * i
    up = 1
    while len(idx) and (done := idx >> FANOUT_BITS * up).any():
        out += done
        up += 1
    return out


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with idx (place in its tree by ``order``) and n (leaves of the tree).

    Rows are dealt by ranges of tree, order and place, so that neither a large tree nor equal rows meet in one task; a
    row's number in its range plus the counts of the ranges before it is its place. ``leaves`` are a written table.
    """
    by = ["tree", *order, "place"]
    spread = leaves.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = cut(spread.withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    dealt_by = dealt.select("*", part, at)
    each = dealt_by.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(
        "tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    out = dealt_by.join(starts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "place", "at", "shift")
    out._dealt = dealt
    return out


def _build(rows: pa.Table, base: int, levels: int) -> pa.Table:
    """The log section of an aligned builder: its nodes above ``base`` (at 0 the leaves too) in completion order."""
    rows = rows.sort_by("idx")
    tree, n = rows["tree"][0].as_py(), rows["n"][0].as_py()
    digests, start, level = rows["digest"].to_pylist(), rows["idx"][0].as_py(), base
    made: list[tuple[int, int, list[str]]] = []
    while True:
        if level == 0 or level > base:
            made.append((level, start, digests))
        if level == base + levels or size_at(n, level) == 1:
            break
        digests = [_hash("".join(digests[i : i + FANOUT])) for i in range(0, len(digests), FANOUT)]
        level, start = level + 1, start >> FANOUT_BITS
    idx = [start + np.arange(len(d)) for _, start, d in made]
    leaves = len(rows) if base == 0 else 0
    blank = sum(map(len, idx)) - leaves
    extra = {c: pa.concat_arrays([rows[c].combine_chunks()[:leaves], pa.nulls(blank, rows[c].type)]) for c in ("name", "doc_id", "claimed")}
    out = pa.table({
        "tree": pa.array([tree] * (leaves + blank), pa.string()),
        "level": pa.array(np.repeat([k for k, _, _ in made], [len(d) for _, _, d in made]), pa.int32()),
        "idx": np.concatenate(idx), "pos": np.concatenate([positions(k, i, n) for (k, _, _), i in zip(made, idx)]),
        "digest": pa.array([d for _, _, own in made for d in own], pa.string()), "n": pa.array([n] * (leaves + blank), pa.int64()),
        "top": np.concatenate([np.full(len(i), size_at(n, k) == 1) for (k, _, _), i in zip(made, idx)]), **extra,
    })
    return out.sort_by("pos")


def _builder(base: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _build(rows, base, levels)


def append_log(leaves: DataFrame, order: list[str], levels: int = LEVELS) -> list[DataFrame]:
    """The log of each tree of ``leaves`` (tree, digest, name, doc_id, claimed; a written table), as written tables: one
    for each ``levels`` levels, lowest first. Each builder's rows are an aligned run of 8 ** levels nodes at most."""
    placed = ranked(leaves, order)
    most = placed.agg(F.max("n")).first()[0] or 0
    rows, logs, base = placed, [], 0
    while base == 0 or size_at(most, base) > 1:
        section = rows.withColumn("section", F.shiftright("idx", FANOUT_BITS * levels))
        logs.append(cut(section.groupBy("tree", "section").applyInArrow(_builder(base, levels), NODE)))
        base += levels
        rows = logs[-1].where((F.col("level") == base) & ~F.col("top"))
    drop_cut(placed._dealt)
    return logs


def _chains(nodes: pa.Table, above: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(row of ``nodes``, texts left and right of it, level by level up to the root) of each node of the lowest level.

    ``nodes`` are a builder's section in log order; siblings are found by their closed-form positions.
    """
    n, level = nodes["n"][0].as_py(), nodes["level"].to_numpy()
    pos, digest = nodes["pos"].to_numpy(), nodes["digest"].to_pylist()
    idx, base, top = nodes["idx"].to_numpy(), int(level.min()), int(level.max())
    chains = {int(idx[level == top][0]): above}
    for k in range(top - 1, base - 1, -1):
        below = {}
        for parent, chain in chains.items():
            run = np.arange(parent << FANOUT_BITS, min((parent + 1) << FANOUT_BITS, size_at(n, k)))
            own = [digest[i] for i in np.searchsorted(pos, positions(k, run, n)).tolist()]
            for i, j in enumerate(run.tolist()):
                below[j] = ["".join(own[:i]), "".join(own[i + 1 :]), *chain]
        chains = below
    at = np.searchsorted(pos, positions(base, np.fromiter(chains, np.int64, len(chains)), n))
    return zip(at.tolist(), chains.values())


def _pass_down(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """For each lowest node of a section what stands beside and above it."""
    nodes = nodes.sort_by("pos")
    at, chains = zip(*_chains(nodes, above["chain"][0].as_py()))
    own = nodes.take(pa.array(at))
    same = lambda c: pa.array([above[c][0].as_py()] * len(own), pa.string())
    return pa.table({"tree": own["tree"], "section": own["idx"], "chain": pa.array(chains, pa.list_(pa.string())), "subroot": same("subroot"), "root": same("root"), "name": own["name"]})


def _prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """For each leaf of a section its proof's digest, and the root that its claimed digest folds to."""
    nodes = nodes.sort_by("pos")
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    at, proofs, folded = [], [], []
    digest, claimed = nodes["digest"].to_pylist(), nodes["claimed"].to_pylist()
    for i, chain in _chains(nodes, above["chain"][0].as_py()):
        now = claimed[i] or digest[i]
        for left, right in zip(chain[::2], chain[1::2]):
            now = _hash(left + now + right)
        at.append(i)
        proofs.append(_hash("".join(chain)))
        folded.append(now)
    own = nodes.take(pa.array(at))
    return pa.table({
        "doc_id": own["doc_id"], "leaf": own["digest"], "subroot": pa.array([subroot] * len(at), pa.string()), "root": pa.array([root] * len(at), pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
    })


_CHAIN = "tree string, section long, chain array<string>, subroot string, root string, name string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(logs: list[DataFrame], tops: DataFrame, last: str = PROOF, levels: int = LEVELS) -> DataFrame:
    """A row for each leaf of ``logs``. Sections are read from the highest to the lowest; each hands its chain of
    siblings to the sections below it, so a node near the root isn't asked for by every leaf. ``tops`` (tree, n, chain,
    subroot, root) says what stands above each tree."""
    above, tops = None, cut(tops)
    for r in reversed(range(len(logs))):
        base = r * levels
        nodes = logs[r] if r == 0 else logs[r].unionByName(logs[r - 1].where((F.col("level") == base) & ~F.col("top")))
        nodes = nodes.withColumn("section", F.expr(f"shiftright(idx, {FANOUT_BITS} * ({base + levels} - level))"))
        own = (F.col("n") <= FANOUT ** (base + levels)) & ((F.col("n") > FANOUT**base) if r else F.lit(True))
        heads = tops.where(own).select("tree", F.lit(0).cast("long").alias("section"), "chain", "subroot", "root")
        if above is not None:
            heads = heads.unionByName(above.drop("name"))
        both = nodes.groupBy("tree", "section").cogroup(heads.groupBy("tree", "section"))
        above = both.applyInArrow(_prove, last) if r == 0 and last == PROOF else both.applyInArrow(_pass_down, _CHAIN)
    return above


def heads(logs: list[DataFrame]) -> DataFrame:
    """(tree, n, digest) of each tree's top node."""
    found = [log.where("top").select("tree", "n", "digest") for log in logs]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _field(c: Column | str) -> Column:
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Of a documents row with this text."""
    return F.sha2(F.concat(_field("doc_id"), _field("source"), _field("lang"), _field("n_chars"), _field(text)), 256)


def manifest(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(logs of the trees of each lang, logs of the tree over their roots): see ``append_log``; ``tree`` is ``=lang``, or
    empty for null. Leaves ascend by doc_id (null first), equal ones by digest; repeated rows are leaves of their own;
    further columns aren't read; an empty table has empty logs. ``claimed`` is kept beside each leaf, to be verified.
    """
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    none = F.lit(None).cast("string")
    leaves = cut(docs.select(
        tree.alias("tree"), leaf_digest(F.col("text")).alias("digest"), none.alias("name"), F.col("doc_id").cast("long").alias("doc_id"),
        (none if claimed is None else claimed).alias("claimed"),
    ))
    logs = append_log(leaves, ["doc_id", "digest"], levels)
    subroots = cut(heads(logs).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"), F.lit(None).cast("long").alias("doc_id"), none.alias("claimed")))
    over = append_log(subroots, ["name"], levels)
    drop_cut(leaves, subroots)
    return logs, over


def verify(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, by a manifest of all of them: the
    root of the rows as they are, and the one that ``claimed`` (or where null the leaf) folds to with the proof."""
    logs, over = manifest(docs, claimed, levels)
    tops = heads(over).select("tree", "n", F.array().cast("array<string>").alias("chain"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    chains = proofs(over, tops, _CHAIN, levels).select(F.col("name").alias("tree"), "chain", "root")
    return proofs(logs, heads(logs).withColumnRenamed("digest", "subroot").join(chains, "tree"), levels=levels)


def tampered(docs: DataFrame) -> Column:
    """A claimed digest where crc32 of the decimal doc_id is divisible by three: the text's A-Z lower-cased."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return F.when(hit & docs["text"].isNotNull(), leaf_digest(F.translate("text", _UP, _LOW)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``verify`` of documents, where texts of ids with crc32 divisible by three are lower-cased in the claim; nulls, ties,
    repeated rows and empty tables as in ``manifest``. A null doc_id or text is never tampered with."""
    docs = table(spark, sf_dir, "documents")
    return verify(docs, tampered(docs))


def _oracle(levels: int = 8, top_levels: int = 4) -> str:
    """SQL of op12 for trees of up to 8 ** levels leaves, and 8 ** top_levels trees."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda t: f"sha256({' || '.join(map(field, ['CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', t]))})"
    byte = "lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), {byte}), 4294967295)"
    parts = [f"""
rows_ AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(f"translate(text, '{_UP}', '{_LOW}')")} ELSE {leaf('text')} END AS f FROM documents),
f0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS x, '' AS proof FROM rows_),
a0 AS (SELECT tree, x AS j, leaf AS d, count(*) OVER (PARTITION BY tree) AS size FROM f0)"""]

    def climb(a: str, k: int, of: str, part: str) -> str:
        return f"""
{a}{k + 1} AS (SELECT tree, j // 8 AS j, CASE WHEN max(size) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY j)) END AS d, (max(size) + 7) // 8 AS size FROM {a}{k} GROUP BY tree, j // 8),
{a}s{k} AS (SELECT p.tree, p.j, any_value(p.size) AS size, coalesce(string_agg(q.d, '' ORDER BY q.j) FILTER (q.j < p.j), '') AS l, coalesce(string_agg(q.d, '' ORDER BY q.j) FILTER (q.j > p.j), '') AS r
  FROM {a}{k} p JOIN {a}{k} q ON p.tree = q.tree AND p.j // 8 = q.j // 8 GROUP BY p.tree, p.j),
{of}{k + 1} AS (SELECT v.* REPLACE (CASE WHEN size = 1 THEN f ELSE sha256(l || f || r) END AS f, CASE WHEN size = 1 THEN proof ELSE proof || l || r END AS proof)
  FROM {of}{k} v JOIN {a}s{k} s ON s.tree = v.{part} AND s.j = v.x // CAST({FANOUT**k} AS BIGINT))"""

    parts += [climb("a", k, "f", "tree") for k in range(levels)]
    parts.append(f"""
b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS j, d, count(*) OVER () AS size, tree AS name FROM a{levels}),
g0 AS (SELECT v.doc_id, v.leaf, v.f, v.proof, b0.d AS subroot, b0.j AS x, '' AS tree FROM f{levels} v JOIN b0 ON b0.name = v.tree)""")
    parts += [climb("b", k, "g", "tree") for k in range(top_levels)]
    return f"WITH {','.join(parts)}\nSELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM g{top_levels} JOIN b{top_levels} r ON true"


ORACLE_SQL = _oracle()
