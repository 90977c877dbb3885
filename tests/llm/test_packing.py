import zlib
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.llm import packing

PATH = packing.tokenizer_path()


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["It's 12 o'clock", "a\x1cb", "<|endoftext|> x", "<|startoftext|>y<|endoftext|>", "a<|b <|endoftext|", "|", "E\u0301 \u0301x", "Σας ΣΑΣ", "\u00a0\u2003 tab\t"]), max_size=4))
def test_words_encode_as_whole_texts(texts):
    for text, got in zip(texts, packing.encode(texts, PATH)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text)[:-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=120))
def test_windows_hold_all_items_once(sizes):
    found = packing.fill_windows(sizes, 2048)
    assert sorted(i for own in found for i in own) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in own) <= 2048 for own in found)


def test_round_trip_and_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(90001, None, "a"), (90002, "", "a"), (None, "x y", "a"), (90003, "na " * 30_000, "b")], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids, at = np.array(ids_of(texts[doc_id]), "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    tokens = sum(r.length for r in rows)
    assert 2048 * len(by_seq) - tokens <= 0.02 * tokens + 2048


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same text")] * 40, "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert len(rows) == 40 and len({(r.sequence_id, r.offset) for r in rows}) == 40
    assert packing.pack(docs.limit(0)).count() == 0
