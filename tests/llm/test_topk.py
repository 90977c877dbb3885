import math

import numpy as np

from rillflow.llm import topk


def slow(rows):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        own = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in ok if i != q)[:5]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(300)]
    rows += [(700, None), (701, [1.0, None]), (None, [1.0] * 8), (750, [float("nan")]), (800, [float("inf")] * 8), (850, []), (851, [3.0, 2.0]), (100, rows[5][1]), (900, [1e6] * 8), (901, [3e5] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    for shard, block in ((topk.SHARD, topk.QUERY_BLOCK), (100, 3)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        got = topk.exact_top(df).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == slow(rows)
    assert topk.exact_top(df.limit(0)).count() == 0
    few = topk.exact_top(df.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(600, 3)) + 20 * rng.integers(0, 4, (600, 1)), np.ones((100, 3))])
    tree = topk.CoverTree(points, leaf=8)
    assert any(tree.children)
    for n, children in enumerate(tree.children):
        if not children:
            continue
        half = np.linalg.norm(points - tree.centre[n], axis=1)
        assert tree.at[children[0]] == tree.at[n]  # nesting
        for i, a in enumerate(children):
            assert tree.radius[a] <= tree.radius[n] / 2 * (1 + 1e-6) + 1e-6  # covering
            for b in children[:i]:
                assert np.linalg.norm(tree.centre[a] - tree.centre[b]) > (tree.radius[n] / 2) * (1 - 1e-6) - 1e-6  # separation
        assert half.shape


def test_far_shards_are_not_searched(spark, monkeypatch):
    """Vectors in groups of unlike directions: most pairs of a block and a shard are told apart by their balls."""
    rng = np.random.default_rng(2)
    axes = np.eye(8)
    rows = [(i, (100 * axes[i % 8] + rng.normal(size=8)).round(3).tolist()) for i in range(1600)]
    seen = []
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    real = topk.cut
    monkeypatch.setattr(topk, "cut", lambda df: seen.append(real(df)) or seen[-1])
    out = topk.exact_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in out.orderBy("query_id", "rank").collect()] == slow(rows)
    shards, blocks = (next(x for x in seen[k:] if "ids" in x.columns).count() for k in (1, 2))
    turns = next(x for x in seen if "turn" in x.columns)
    assert turns.count() < shards * blocks / 2
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
