import corpus_pipeline as p
from rillflow.llm import linededup, simhash, toxicity

from .test_decontaminate import slow as slow_overlap
from .test_linededup import slow as slow_lines
from .test_packing import ids_of
from .test_simhash import slow_components


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 900 and doc_id < 110")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns

    def rows(df):
        assert df.columns == columns
        return sorted((r.doc_id, r.text) for r in df.collect())

    now, out = docs, rows(docs)
    (_, toxic), (_, lines), (_, near), (_, clean), (_, pack) = p.STAGES
    model = toxicity.learned(docs, labels)
    bad = {r.doc_id for r in toxicity.scored(docs, model).where("__score >= 0.5").collect()}
    now = toxic(spark, now, sf_dir)
    out = [r for r in out if r[0] not in bad]
    assert rows(now) == out
    gone = slow_lines(out)
    want = dict((d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, (d, t) in enumerate(out))
    now = lines(spark, now, sf_dir)
    got = rows(now)
    # Lines meet by blocks and bands, which may miss a link: no line goes that all pairs wouldn't drop, and few stay.
    assert [d for d, _ in got] == [d for d, _ in out]
    left, least, most = (sum(len(t.split("\n")) for _, t in own) for own in (got, want.items(), out))
    assert least <= left <= least + 0.1 * (most - least)
    out = got
    keep = {c for _, _, c in slow_components(out)}
    out = [r for r in out if r[0] in keep]
    now = near(spark, now, sf_dir)
    assert rows(now) == out
    out = [r for r in out if not slow_overlap(r[1], bench)[-1]]
    now = clean(spark, now, sf_dir)
    assert rows(now) == out
    packed = pack(spark, now, sf_dir).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {d: len(ids_of(t)) for d, t in out}
    assert linededup.SIMILARITY == 0.8 and simhash.MAX_DISTANCE == 4


def test_run(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
