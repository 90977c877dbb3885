import zlib

import numpy as np
import pytest

from rillflow.llm import toxicity as t

INSULTS = ["vargling", "smeltod", "dunkard", "pustrel"]


def texts(n, seed, vocabulary):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(15, 60)))
        if i % 3 == 0:
            words[rng.integers(len(words))] = str(rng.choice(INSULTS))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def vocabulary():
    rng = np.random.default_rng(0)
    return ["".join(rng.choice(["ta", "re", "on", "mi", "ba", "lu", "es"], rng.integers(1, 5))) for _ in range(600)]


def test_collapsed_weights_equal_the_landmark_kernel():
    marks, words = ["<abcd>", "<hello>", "<aaaa>"], ["<abxcd>", "<helo>", "<zzz>", "<aaaa>"]
    slow = np.zeros((4, 3))
    for i, s in enumerate(words):
        for j, z in enumerate(marks):
            for a in range(len(s)):
                for b in range(a + 1, len(s)):
                    for c in range(b + 1, min(len(s), a + t.SPAN + 1)):
                        for x in range(len(z)):
                            for y in range(x + 1, len(z)):
                                for v in range(y + 1, min(len(z), x + t.SPAN + 1)):
                                    if s[a] + s[b] + s[c] == z[x] + z[y] + z[v]:
                                        slow[i, j] += t.DECAY ** (c - a + 1 + v - x + 1)
    slow /= t._norms(words)[:, None] * t._norms(marks)[None, :]
    assert np.allclose(t.kernel_with(words, marks), slow)


def test_disguised_words_are_found(spark, vocabulary):
    rows = texts(600, 1, vocabulary)
    model = t.train([x for x, _ in rows], [y for _, y in rows])
    base = " ".join(vocabulary[:40])
    odd = ["vargling", "v a r g l i n g", "v.a.r.g.l.i.n.g", "varrgling", "vargl1ng", "dunk-ard", "SMELTOD!", "smeltxod"]
    cases = [(i, f"{base} {w} {base}", "toxic") for i, w in enumerate(odd)]
    cases += [(100 + i, x, "clean") for i, (x, y) in enumerate(texts(150, 2, vocabulary)) if not y]
    cases += [(900, None, "clean"), (901, "", "clean"), (None, "smeltod", "toxic"), (902, " ".join(vocabulary * 200) + " pustrel", "toxic"), (903, "ab" * 50_000, "clean")]
    docs = spark.createDataFrame([(*c, 1.0) for c in cases], "doc_id long, text string, want string, score double")
    got = t.scored(docs, model).collect()
    assert len(got) == len(cases)
    wrong = [r for r in got if (r["__score"] >= 0.5) != (r.want == "toxic")]
    assert len(wrong) <= 0.03 * len(cases), wrong


def test_held_out_accuracy(spark, vocabulary):
    rows = texts(900, 3, vocabulary)
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    model = t.learned(docs, labels)
    got = {r.doc_id: r["__score"] >= 0.5 for r in t.scored(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == bool(rows[i][1]) for i in held]) > 0.97
    kept = t.reject_toxic(docs.withColumnRenamed("doc_id", "doc_id"), labels)
    assert kept.columns == docs.columns


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["__score"] for r in t.scored(docs, t.learned(docs, labels)).collect()] == [0.0, 0.0]
    assert t.scored(docs.limit(0), None).count() == 0
