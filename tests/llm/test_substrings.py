import hashlib

import numpy as np
import pytest

from rillflow.llm import substrings as s


def slow(rows):
    """Bytes of each distinct (doc_id, text) covered by a 100-byte string seen earlier."""
    def place(row):
        return (row[0] is None, row[0] or 0, row[2])

    seen, out = set(), {}
    for doc_id, text, _ in sorted(set(rows), key=place):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [(s.CONTEXT_LIMIT, s.GRAM_LIMIT), (3, 1000), (2, 3)])
def test_against_brute_force(spark, limits):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abé d"), n))
    shared = [word(n) for n in (99, 100, 101, 130, 400, 60, 250)]
    rows = []
    for d in range(60):
        parts = [word(rng.integers(0, 120))]
        for _ in range(rng.integers(0, 4)):
            piece = str(rng.choice(shared))
            a = rng.integers(0, 30)
            parts += [piece[a:], word(rng.integers(0, 90))]
        rows.append((d, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "z" * 700), (201, "xy" * 300), (202, None), (203, ""), (204, "q" * 99), (None, rows[7][1] + "tail")]
    rows += [(300 + i, rows[9][1][:150] + word(5) + rows[9][1][150:]) for i in range(8)]
    rows += [(7, rows[7][1]), (400, word(3000) + shared[4] + word(2000))]
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], "doc_id long, text string, tie int, bytes string").repartition(5)
    got = s.remove_repeats(docs, *limits).collect()
    ties = {(r.doc_id, r.text): r.tie for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as tie").collect()}
    want = slow([(d, t, ties[d, t]) for d, t in rows])
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(((d, *want[d, t]) for d, t in rows), key=str)
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_anchors_cover_each_string_once():
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdef"), 3000))
    data = long.encode()
    whole = s.anchors_of(np.frombuffer(data, np.uint8), np.array([len(data)]))
    covered = np.zeros(len(data) - 99, int)
    for a, b in zip(whole[2], whole[3]):
        covered[a : b + 1] += 1
    assert (covered == 1).all() and len(whole[0]) < len(data) / 25


def test_longest_previous_factors():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 380, 3)
    rank = rng.permutation(len(starts))
    got = s.longest_previous_factors(text, starts, rank, 20)
    raw = text.tobytes()
    for i, a in enumerate(starts):
        best = 0
        for j, b in enumerate(starts):
            if rank[j] < rank[i]:
                k = 0
                while k < 20 and raw[a + k] == raw[b + k]:
                    k += 1
                best = max(best, k)
        assert got[i] == best
