import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import collocations as co


def slow(rows, least, top=co.TOP):
    langs = {}
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        langs.setdefault("und" if lang is None else lang, []).extend(re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text))
    out = []
    for lang, pieces in langs.items():
        f = Counter(tuple(p[i : i + m]) for p in pieces for m in range(1, 6) for i in range(len(p) - m + 1))
        n = sum(map(len, pieces))
        several = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in several.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in several.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n, size):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "Éa", "a", "b\x00", "x-y", " ", "z\x1c"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", " "]
    out = []
    for _ in range(n):
        words_ = [rng.choice(words if rng.random() < 0.7 else words[:3]) for _ in range(rng.randrange(size))]
        out.append("".join(w + rng.choice(gaps) for w in words_))
    return out


@pytest.mark.parametrize("route_rows", [co.ROUTE_ROWS, 5])
def test_against_brute_force(spark, route_rows):
    rows = [(("en", "de", None, "und", "")[i % 5], t) for i, t in enumerate(texts(1, 60, 60))]
    rows += [("en", None), ("en", ""), (None, " .. "), ("hot", "in the end of the day " * 3000), ("rep", "aa aa aa aa aa aa aa aa aa")] + [("copy", "Alpha beta, gamma delta eps zeta eta")] * 40
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    for least in (3, 12):
        got = sorted(map(tuple, co.collocations(df, least=least, route_rows=route_rows).collect()))
        assert got == slow(rows, least)
    assert sorted(map(tuple, co.collocations(df, least=3, top=4, route_rows=route_rows).collect())) == slow(rows, 3, 4)
    assert co.collocations(df.limit(0)).count() == 0
    assert co.collocations(df.limit(3), least=10**6).count() == 0


def test_sql_against_brute_force(spark):
    rows = [(("en", None)[i % 2], t) for i, t in enumerate(texts(2, 400, 40))]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "lang string, text string").toPandas())
    want = slow(rows, 100)
    assert len(want) > 5 and sorted(con.execute(co.ORACLE_SQL).fetchall()) == want


def test_large_products_are_exact(spark):
    row = spark.sql("select (1000 * cast(9000000000001 as decimal(19,0)) * cast(80000000000003 as decimal(19,0))) div (cast(9000000000002 as decimal(19,0)) * cast(9000000000001 as decimal(19,0))) as s").first()
    assert row.s == 1000 * 9000000000001 * 80000000000003 // (9000000000002 * 9000000000001)


def test_equal_partitions():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 4, (500, 4)).astype(np.int32)
    for row in keys:  # 0 ends a row
        row[np.cumsum(row == 0) > 0] = 0
    weight = rng.integers(1, 5, 500)
    for least in (1, 30):
        want = Counter()
        for row, w in zip(keys.tolist(), weight.tolist()):
            for d in range(4):
                if row[d]:
                    want[tuple(row[: d + 1])] += w
        got = {tuple(keys[r, : d + 1].tolist()): n for r, d, n in co.equal_partitions(keys, weight, least)}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_words_are_held_some_at_a_time(monkeypatch):
    rows = [("en", "a b, c"), (None, None), ("de", "x y z"), ("en", "d e\nf"), ("en", "one piece without a mark in it. g"), ("en", "")]
    batch = pa.record_batch({"lang": pa.array([r[0] or "und" for r in rows]), "text": pa.array([r[1] for r in rows])})
    whole = {lang: words for lang, words in co._by_lang(batch)}
    monkeypatch.setattr(co, "TEXT_BYTES", 4)
    parts = {}
    for lang, words in co._by_lang(batch):
        parts.setdefault(lang, []).append(words)
    assert {lang: [w for p in some for w in p] for lang, some in parts.items()} == whole
    assert [len(p) for p in parts[b"en"]] == [5, 5, 8, 1]
    assert all(p[-1] == b"\n" for some in parts.values() for p in some[:-1])  # no phrase goes on in another part
