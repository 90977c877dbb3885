from rillflow.llm import pii


def test_disguised_address_without_digits():
    for text in ("write to jane.roe (at) example.com", "jane.roe[at]example.com", "Jane.Roe AT example.com", "to {j.r {at} example dot org}"):
        found = pii.candidates_of(text, [])
        assert [c["kind"] for c in found] == [0], text
    assert pii.candidates_of("we met at the gate", []) == []


def test_thresholds_count_all_held_out_candidates(spark):
    # Many more wrong candidates than a sample holds: of all rows from 0.75 on, far fewer than 97 % are right.
    rows = spark.range(90_000).selectExpr("3 as kind", "cast(id < 6000 as int) as label", "case when id < 3000 then 0.9375 when id < 6000 or id % 10 = 0 then 0.75 else 0.25 end as p")
    assert pii.thresholds(rows) == {3: 0.9375}


def test_held_out_negatives_beyond_the_sample_count(spark, monkeypatch):
    """2 right and 98 wrong of each hundred look alike: a mix capped at equal numbers may not set their threshold."""
    x = [0.0] * len(pii.FEATURES)
    seen = {}
    monkeypatch.setattr(pii, "thresholds", lambda scored: seen.update(n=scored.count(), right=scored.where("label = 1").count()) or {})
    rows = spark.range(3000).selectExpr("cast(id as string) as key", "0 as start", "3 as kind", "9 as end", "0 as made", "cast(id % 50 = 0 as int) as label", "1 as fresh")
    rows = rows.selectExpr("*", f"transform(array({','.join(map(str, x))}), v -> cast(v + label as float)) as x")
    pii.trained(rows, sample=50)
    assert 900 < seen["n"] < 1100 and seen["right"] < 40
