import numpy as np
import pytest
import xxhash

from rillflow.llm import graph
from rillflow.llm.simhash import covering_positions, fingerprint, near_dedup, simhash_components


def slow_fingerprint(text):
    words = []
    word = ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def test_covering_triples_are_few():
    assert len(covering_positions()) <= 24


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c d e F g", "É é\x0bx y\x85z w", "the cat " * 5000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(120):
        text = list(rng.choice(words, rng.integers(3, 80)))
        rows.append((d, " ".join(text)))
        for _ in range(rng.integers(0, 5)):
            text[rng.integers(len(text))] = str(rng.choice(words))
            rows.append((1000 + len(rows), " ".join(text)))
    rows += [(7, rows[0][1]), (None, rows[3][1]), (None, None), (9000, ""), (9001, None), (9001, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, bits string")
    got = simhash_components(docs).selectExpr("doc_id", "lower(lpad(hex(bits), 16, '0'))", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_components(rows)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    by_class = {c for _, _, c in slow_components(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(by_class)


def test_long_lists_lose_no_link(spark):
    rng = np.random.default_rng(2)
    bits = sorted({int(b) for b in rng.integers(0, 1 << 9, 300)})
    index = spark.createDataFrame([(k, b, b) for b in bits for k in (1, 2)], "key long, id long, bits long")
    for limit, together in ((7, 0), (10_000, 10_000)):
        found = graph.components(graph.link_lists(index.drop("id") if limit == 7 else index, 1, limit=limit), together).collect()
        adjacent = {b: [c for c in bits if (b ^ c).bit_count() <= 1] for b in bits}
        root = {}
        for b in bits:
            todo = [] if b in root else [b]
            while todo:
                c = todo.pop()
                if c not in root:
                    root[c] = b
                    todo += adjacent[c]
        assert {r.node: r.root for r in found} == {b: r for b, r in root.items() if b != r}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).count() == 0
    assert near_dedup(docs).count() == 0


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, "x", "y", "z"), (2, "a b c d e", 6, "x", "y", "z")], "doc_id long, text string, __n int, __key string, key string, row string")
    (kept,) = near_dedup(docs).collect()
    assert tuple(kept) == (1, "a b c d e", 5, "x", "y", "z")
