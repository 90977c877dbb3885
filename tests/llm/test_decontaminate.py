import hashlib
import re

import numpy as np

from rillflow.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def slow(text, items):
    ws, hit, met = words(text), set(), set()
    for item_id, t in items:
        iw = words(t)
        n = min(13, len(iw))
        for j in range(len(iw) - n + 1) if n else ():
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[j : j + n]:
                    hit |= set(range(i, i + n))
                    met |= {str(item_id)} if item_id is not None else set()
    return len(ws), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(6)] + ["été", "ÀB", "x1"]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([3, 13, 14, 30, 12, 1, 0, 40])] + [(None, "zz " * 14), (3, "w1, w1!"), (90, None), (10, "q " * 20)]
    texts = [None, "", "...", "w1-W1", items[3][1].upper(), "q " * 200]
    for _ in range(60):
        text = list(rng.choice([*vocab, "other"], rng.integers(1, 60)))
        own = str(items[rng.integers(8)][1]).split()
        cut = rng.integers(0, 5)
        texts.append(" ".join(text[:20] + own[cut:] + text[20:]))
    texts.append("pad " * 3000 + items[7][1] + " pad" * 3000)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, texts[8], 0), (4, texts[4], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, *slow(t, items)) for i, t in enumerate(texts)]
    want += [(None, *want[8][1:]), want[4]]
    for block in (d.BLOCK_BYTES, 40):
        got = d.judged(d.overlaps(docs, bench, block)).drop("key").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clean = d.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[-1]), key=str)
    assert d.overlaps(docs.limit(0), bench).count() == 0
    assert d.judged(d.overlaps(docs, bench.limit(0))).where("contaminated").count() == 0


def slow_longest(ws, iw):
    best = (0, 0, 0)
    for i in range(len(ws)):
        for j in range(len(iw)):
            n = 0
            while i + n < len(ws) and j + n < len(iw) and ws[i + n] == iw[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    return best


def test_longest_matches(spark):
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"{i}v{k}" for k in range(30))) for i in range(4)]
    rows = []
    for k in range(25):
        own = items[rng.integers(4)][1].split()
        a, n = rng.integers(0, 10), rng.integers(10, 21)
        rows.append((k, " ".join(["pad"] * rng.integers(0, 9) + own[a : a + n] + ["pad"] + own[: rng.integers(5, 25)])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, d.longest_matches(docs, bench).collect()))
    want = []
    for doc_id, text in rows:
        for item_id, t in items:
            i, j, n = slow_longest(words(text), words(t))
            if n >= 13:
                want.append((doc_id, item_id, i, j, n))
    assert got == sorted(want)
