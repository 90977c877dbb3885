import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from rillflow.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_positions(n):
    """Of all nodes of a tree of n leaves, in the order in which a walk leaves them."""
    height = 0
    while merkle.size_at(n, height) > 1:
        height += 1
    out = []

    def walk(level, j):
        if level:
            for c in range(8 * j, min(8 * j + 8, merkle.size_at(n, level - 1))):
                walk(level - 1, c)
        out.append((level, j))

    walk(height, 0)
    return {node: i for i, node in enumerate(out)}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 15, 16, 63, 64, 65, 71, 72, 73, 511, 512, 513, 600, 4097])
def test_closed_form_is_postorder(n):
    for (level, j), at in slow_positions(n).items():
        assert merkle.positions(level, np.array([j]), n).tolist() == [at]


def fold(nodes):
    """(root, siblings by level for each leaf, as (left, right))."""
    chains, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, j in enumerate(owner):
            run = 8 * (j // 8)
            chains[i].append(("".join(nodes[run:j]), "".join(nodes[j + 1 : run + 8])))
        owner = [j // 8 for j in owner]
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0] if nodes else None, chains


def slow(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, la, n, t: h(*map(field, (d, s, la, n, t)))
    trees = {}
    for d, text, lang, source, n in rows:
        changed = text
        if d is not None and text is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees.setdefault(lang, []).append((d is not None, d or 0, leaf(d, source, lang, n, text), leaf(d, source, lang, n, changed), d))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {x: fold([r[2] for r in sorted(trees[x])]) for x in langs}
    root, over = fold([made[x][0] for x in langs])
    out = []
    for x, up in zip(langs, over):
        for (_, _, own, claim, d), chain in zip(sorted(trees[x]), made[x][1]):
            now = claim
            for left, right in chain + up:
                now = h(left, now, right)
            out.append((d, own, made[x][0], root, h(*(s for p in chain + up for s in p)), now, now == root))
    return sorted(out, key=str)


def rows_of(langs):
    rows = [(i, f"Text {i}\né" if i % 7 else "lower", lang, f"s{i % 3}", i) for lang, n in langs.items() for i in range(n)]
    return rows + [(3, None, "xx", None, None), (None, "A", "xx", None, 1), (None, None, None, None, None), (5, "", "", "", 0), (9, "X" * 100_000, "long", "s", -1)] + [(4, "Same", "rep", "s", 1)] * 30


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def got_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 4])
def test_against_brute_force(spark, levels, tmp_path):
    rows = rows_of({"en": 150, "de": 64, "fr": 1, "es": 9, "z1": 2, "z2": 2, "z3": 2})
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, tree int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = got_of(merkle.verify(docs, merkle.tampered(docs), levels))
    assert got == slow(rows)
    assert {r[-1] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(merkle.ORACLE_SQL).fetchall(), key=str) == got


def test_small_tables(spark):
    for rows in ([], [(1, "A", "en", "s", 1)], [(1, "A", None, "s", 1)] * 8):
        df = spark.createDataFrame(rows, SCHEMA)
        assert [r[1:5] for r in got_of(merkle.verify(df))] == [r[1:5] for r in slow(rows)]


def test_the_log_is_a_postorder(spark):
    rows = rows_of({"en": 600})
    logs, over = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    en = sorted((r.pos, r.level, r.idx) for log in logs for r in log.where("tree = '=en'").collect())
    assert {(k, j): p for p, k, j in en} == slow_positions(600)
    assert sum(log.where("top").count() for log in over) == 1


def test_sections_by_position(spark):
    """A builder's part of the log is one run of positions."""
    logs, _ = merkle.manifest(spark.createDataFrame([(i, "x", "en", "s", 1) for i in range(9000)], SCHEMA))
    low = logs[0].selectExpr("pos", "shiftright(idx, 3 * (4 - level)) AS section").groupBy("section").agg({"pos": "max", "*": "count"}).collect()
    first = logs[0].where("level = 0 and idx % 4096 = 0").collect()
    assert {r.section: r["max(pos)"] - r["count(1)"] + 1 for r in low} == {r.idx // 4096: r.pos for r in first}
