"""Packing of token sequences by Karmarkar-Karp multiway differencing (operator 3)."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW, END_ID = 2048, 1
#: A document's end shorter than a window is cut into pieces of at most this many tokens, so that differencing can even windows out.
PIECE = 512
#: Windows that one differencing fills; a block of pieces has about so many windows' tokens.
BLOCK_WINDOWS = 256
#: Words whose ids a worker keeps; the store is emptied when full.
KEPT_WORDS = 1_000_000
# Python splits at these too, the tokenizer does not; "<|" may begin a special token: such texts go to it whole.
_ODD = re.compile("[\x1c-\x1f\u180e\u200b\ufeff]|<\\|")
#: A special token of the tokenizer; between words that have no "<|" it parts their ids.
MARK = "<|endoftext|>"
_WORDS: dict[str, dict[str, bytes]] = {}
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _WORDS[path] = {}
    return _LOADED[path]


def plain_form(word: str) -> tuple[str, str]:
    """A word and the sign at its end, which the tokenizer splits from a letter before it; ASCII in lower case, as it reads it."""
    base, tail = (word[:-1], word[-1]) if len(word) > 1 and word[-1] in ".,;:!?|" and word[-2].isalpha() else (word, "")
    return (base.lower() if base.isascii() else base), tail


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers: those of the tokenizer's plain call without added
    special tokens, so that a special token's string in a text is that token.

    The tokenizer never joins characters across white space, so each unknown word of the texts is encoded once, all in
    one call with a special token between them.
    """
    tokenizer = _tokenizer(path)
    if len(_WORDS[path]) > KEPT_WORDS:
        _WORDS[path] = {}
    known = _WORDS[path]

    def raw(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    words = [None if _ODD.search(text) else text.split() for text in texts]
    new = {w: plain_form(w) for w in set().union(*filter(None, words)).difference(known)}
    forms = list({f for pair in new.values() for f in pair}.difference(known))
    if forms:
        ids = raw(MARK.join(forms))
        ends = (4 * np.flatnonzero(ids == tokenizer.token_to_id(MARK))).tolist()
        flat = ids.tobytes()
        known.update(zip(forms, [flat[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(flat)])]))
        known.update((w, known[base] + known[tail]) for w, (base, tail) in new.items())
    return [raw(text).tobytes() if own is None else b"".join(map(known.__getitem__, own)) for text, own in zip(texts, words)]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of each window. Two partial partitions of greatest spread merge, the fullest windows of
    one with the emptiest of the other, until one is left."""
    heap = [(-s, i, np.array([s]), [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, own_a = heapq.heappop(heap)
        _, _, b, own_b = heapq.heappop(heap)
        # Sums are kept in falling order without the zeros of unused windows.
        if len(a) < len(b):
            a, own_a, b, own_b = b, own_b, a, own_a
        free = windows - len(a)
        if len(b) <= free:
            sums, own = np.concatenate([a, b]), own_a + own_b
        else:
            sums, own = np.concatenate([a, np.zeros(free, a.dtype)]), own_a + [[] for _ in range(free)]
            for k in range(len(b)):
                sums[-1 - k] += b[k]
                own[-1 - k] = own[-1 - k] + own_b[k]
        by = np.argsort(-sums, kind="stable")
        sums, own = sums[by], [own[k] for k in by]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-int(spread), order, sums, own))
        order += 1
    return heap[0][3] if heap else []


def fill_windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; the window count rises whenever capacity is exceeded."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if all(sum(sizes[i] for i in own) <= capacity for own in found):
            return found
        windows += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Each document's ids cut into pieces: whole windows, which have their sequence_id, and short ends without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows: list[tuple] = []
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode(texts, path)):
                    ids += END_ID.to_bytes(4, "little")
                    total, start = len(ids) // 4, 0
                    while start < total:
                        length = window if total - start >= window else min(piece, total - start)
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        place = (part << 33) + n
                        rows.append((doc_id, start, length, crc, total, 2 * place if length == window else None, place))
                        n, start = n + 1, start + length
                if rows:
                    names = [c.split()[0] for c in PIECES.split(", ")]
                    yield pa.record_batch({name: pa.array(v, pa.int64()) for name, v in zip(names, zip(*rows))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, piece: int = PIECE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Pack all documents' ids into sequences of at most ``window`` tokens: one row per piece.

    Whole windows are cut off each document as they are. The ends are dealt by hash into blocks of about
    ``block_windows`` windows' tokens, and differencing fills near-equal windows from each block, so a task holds one
    block at a time and padding is about a window a block. Sequence ids are unique, not dense. A null text or doc_id
    keeps its row (the text counts as empty: one piece with the end id); repeated rows are packed as often as they come.
    """
    pieces = cut(token_pieces(docs, path or tokenizer_path(), window, piece))
    whole = pieces.where("sequence_id is not null").select(*PIECES.replace("long", "").replace(",", "").split()[:-1], F.lit(0).cast("long").alias("offset"))
    ends = pieces.where("sequence_id is null")
    total = ends.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (window * block_windows)))

    def fill(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by("place")
            block, sizes = table["block"][0].as_py(), table["length"].to_pylist()
            take, seq, offset = [], [], []
            for k, own in enumerate(fill_windows(sizes, window)):
                at = 0
                for i in own:
                    take.append(i)
                    seq.append(2 * ((block << 24) + k) + 1)
                    offset.append(at)
                    at += sizes[i]
            chosen = table.take(pa.array(take, pa.int64()))
            names = [c.split()[0] for c in PACKED.split(", ")]
            made = {"sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64())}
            return pa.table({c: made.get(c, chosen[c] if c in chosen.column_names else None) for c in names}).combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        for batch in groups:
            blocks_ = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks_[1:] != blocks_[:-1]) + 1).tolist(), len(blocks_)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if held and held[0].column("block")[0].as_py() != blocks_[a]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(pa.Table.from_batches(held))

    dealt = ends.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks))).drop("sequence_id")
    dealt = dealt.repartition("block").sortWithinPartitions("block")
    return whole.unionByName(dealt.mapInArrow(fill, PACKED))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of documents; nulls, repeated rows and an empty table as there."""
    return pack(table(spark, sf_dir, "documents"))
