import random

from pyspark.sql import functions as F

from rillflow.functions import udfs
from rillflow.operators import changelog, joins


def test_range_lookup_of_any_width(spark):
    rng, rules, at = random.Random(7), [], -(2**40)
    for k in range(60):
        at += rng.choice([1, 5, 1000, 10**6, 10**9])
        end = at + rng.choice([0, 3, 500, 10**5, 10**8, 10**11])
        rules.append((at, end, f"r{k}"))
        at = end + 1
    rules.append((2**50, 2**62, "widest"))
    values = [b + d for r in rules for b in r[:2] for d in (-1, 0, 1)] + [rng.randrange(-(2**41), 2**51) for _ in range(200)] + [None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v long")
    frame = spark.createDataFrame([*rules, (None, 5, "no low end")], "low long, high long, name string")
    out = joins.range_lookup(df, frame, "v", "low", "high", 10, {"name": F.lit("-")}, max_cells=16)
    assert out.columns == ["id", "v", "low", "high", "name"]
    expected = {(k, next((n for a, b, n in rules if v is not None and a <= v <= b), "-")) for k, v in enumerate(values)}
    rows = out.select("id", "name").collect()
    assert len(rows) == len(values) and {tuple(r) for r in rows} == expected
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    none = joins.range_lookup(df, frame.limit(0), "v", "low", "high", 10, {"name": F.lit("-")})
    assert none.where("name = '-'").count() == len(values)


def test_segmenter(spark):
    known = ["北京", "北京大学", "大学", "学生"]
    words = spark.createDataFrame([(w,) for w in [*known, "", None]], "w string")
    segment = udfs.segmenter(udfs.dictionary_of(words))
    df = spark.createDataFrame([(1, "北京大学生 ok"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.words for r in df.select("id", segment("text").alias("words")).collect()}
    assert got == {1: ["北京大学", "生", "o", "k"], 2: [], 3: None}


def test_outer_join_changelog(spark):
    left = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (None, 10)], "k int, a long")
    right = spark.createDataFrame([(1, 5, "early"), (1, 20, "late"), (2, 30, "after"), (2, 40, "last"), (None, 1, "none")], "k int, b long, v string")
    out = changelog.outer_join_changelog(left, right, "k", "a", "b")
    got = sorted((r.k or 0, r.seq, r.op, r.v or "") for r in out.collect())
    assert got == [
        (0, 10, "+I", ""), (1, 10, "+I", "early"), (1, 20, "+I", "late"), (2, 10, "+I", ""), (2, 30, "+I", "after"), (2, 30, "-D", ""), (2, 40, "+I", "last"), (3, 10, "+I", ""),
    ]
    assert changelog.outer_join_changelog(left, right.limit(0), "k", "a", "b").count() == 4
