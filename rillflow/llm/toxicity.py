"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks (operator 5)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, table

#: Labelled documents of each label that are learned from at most; which ones is decided by a hash of their ids.
SAMPLE = {1: 1500, 0: 2500}
LANDMARKS, ROUNDS = 240, 3
#: Subsequences are of three characters that span at most SPAN + 1; each character spanned counts DECAY.
SPAN, DECAY = 5, 0.6
#: A longer unit is read in overlapping windows of so many characters.
UNIT = 24
#: Windows of a clean unit that a round learns from at most.
CLEAN_WINDOWS = 8
FOLDS = 5
#: Words whose scores a worker keeps; the store is emptied when full.
KEPT_WORDS = 400_000
# Fixed: characters that stand for letters in disguised words.
LEET = str.maketrans("013457@$!", "oieastasi")
_ALPHABET = "<>abcdefghijklmnopqrstuvwxyz"
_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_OFFSETS = [(j, k) for k in range(2, SPAN + 1) for j in range(1, k)]
_CODES = 64**3
_ids: dict[str, int] = {c: i for i, c in enumerate(_ALPHABET)}


def unit_of(word: str) -> str:
    """The letters of a word in lower case; signs between letters go, and signs that stand for letters are read so."""
    low = word.lower()
    if not low.isalpha():
        if any(c.isalpha() for c in low):
            low = low.strip(".,;:!?\"'()|").translate(LEET)
        low = _NOT_LETTERS.sub("", low)
    return low


def spaced_units(text: str) -> list[str]:
    """Runs of at least three single characters between blanks, joined: words with blanks inserted."""
    return ["".join(m[0].split()) for m in _SPACED.finditer(text)]


def _windows(unit: str) -> list[str]:
    marked = f"<{unit}>"
    if len(marked) <= UNIT:
        return [marked]
    return [marked[i : i + UNIT] for i in range(0, len(marked) - UNIT // 2, UNIT // 2)]


def _encoded(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes, padded with -1, and lengths."""
    lengths = np.array([len(w) for w in windows])
    flat = np.array([_ids.get(c) if c in _ids else len(_ALPHABET) + ord(c) % 36 for c in "".join(windows)], np.int64)
    out = np.full((len(windows), max(UNIT, 3)), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out, lengths


def _subsequences(windows: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(window, code, weight) of all subsequences of three characters."""
    chars, lengths = _encoded(windows)
    for j, k in _OFFSETS:
        a, b, c = chars[:, :-k], chars[:, j : j - k], chars[:, k:]
        row, col = np.nonzero(c >= 0)
        yield row, (a[row, col] * 64 + b[row, col]) * 64 + c[row, col], DECAY ** (k + 1)


def _norms(windows: list[str]) -> np.ndarray:
    lengths = np.array([len(w) for w in windows])
    each = sum(np.maximum(lengths - k, 0) * DECAY ** (2 * k + 2) for _, k in _OFFSETS)
    return np.sqrt(np.maximum(each, 1e-12))


def kernel_with(windows: list[str], landmarks: list[str]) -> np.ndarray:
    """The gap-weighted subsequence kernel of each window with each landmark, divided by what depends on length alone."""
    codes: dict[int, int] = {}
    entries: list[tuple[int, int, float]] = []
    for row, code, weight in _subsequences(landmarks):
        for r, c in zip(row.tolist(), code.tolist()):
            entries.append((codes.setdefault(c, len(codes)), r, weight))
    table_ = np.zeros((len(codes) + 1, len(landmarks)))
    for at, r, weight in entries:
        table_[at, r] += weight
    table_ /= _norms(landmarks)[None, :]
    place = np.full(_CODES, len(codes))
    place[list(codes)] = list(codes.values())
    out = np.zeros((len(windows), len(landmarks)))
    for at in range(0, len(windows), 2000):
        some = windows[at : at + 2000]
        part = np.zeros((len(some), len(landmarks)))
        for row, code, weight in _subsequences(some):
            where = place[code]
            hit = where < len(codes)
            np.add.at(part, row[hit], weight * table_[where[hit]])
        out[at : at + 2000] = part / _norms(some)[:, None]
    return out


@dataclass
class Model:
    """A linear function of the landmark kernels, kept as one weight for each subsequence; then a calibrated logistic."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def window_scores(self, windows: list[str]) -> np.ndarray:
        out = np.zeros(len(windows))
        for at in range(0, len(windows), 4000):
            some = windows[at : at + 4000]
            total = np.zeros(len(some))
            for row, code, weight in _subsequences(some):
                total += weight * np.bincount(row, self.weights[code], len(some))
            out[at : at + 4000] = total / _norms(some) + self.bias
        return out

    def unit_scores(self, units: list[str]) -> np.ndarray:
        """The greatest score of each unit's windows."""
        out = np.full(len(units), -np.inf)
        for at in range(0, len(units), 4000):
            each = [_windows(u) for u in units[at : at + 4000]]
            owner = np.repeat(np.arange(at, at + len(each)), [len(own) for own in each])
            np.maximum.at(out, owner, self.window_scores([w for own in each for w in own]))
        return out

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(top, -5) + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps over its support vectors."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w)) / cost
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(30):
        active = y * (x1 @ w) < 1
        if before is not None and (active == before).all():
            break
        own = x1[active] * weight[active, None]
        w = np.linalg.solve(ridge + own.T @ x1[active], own.T @ y[active])
        before = active
    return w[:-1], float(w[-1])


def _pieces(text: str) -> set[str]:
    return {text[i : i + n] for n in (4, 5, 6) for i in range(max(1, len(text) - n + 1))}


def _initial(units: list[str], docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    """Log odds of the best piece of four to six characters of each unit, by documents of either label that have it, and
    those of all pieces."""
    grams: dict[str, int] = {}
    of_unit = [np.array([grams.setdefault(g, len(grams)) for g in _pieces(f"<{u}>")]) for u in units]
    seen = np.zeros((2, len(grams)))
    for own, label in zip(docs, labels):
        if len(own):
            seen[label, np.unique(np.concatenate([of_unit[i] for i in own]))] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen[1] < 2] = -1
    return np.array([odds[own].max() for own in of_unit]), dict(zip(grams, odds.tolist()))


def train(texts: Iterable[str], labels: Iterable[int], seed: int = 17) -> Model | None:
    """Learn units from labelled texts: a toxic text holds at least one toxic unit, the others hold none.

    Rounds choose each toxic text's best unit and each clean text's most mistaken ones, and fit the machine to them: to
    the likeliest window of a toxic unit and to CLEAN_WINDOWS of a clean one at most. A quarter of the texts is kept for the
    calibration. None without texts of both labels. Texts are read once, one at a time; labels after them.
    """
    at: dict[str, int] = {}
    docs = []
    for text in texts:
        found = {unit_of(w) for w in set(text.split())} | {unit_of(w) for w in spaced_units(text)}
        docs.append(np.array(sorted(at.setdefault(u, len(at)) for u in found if u), int))
    y = np.array(list(labels), int)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    units = list(at)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        held[own[: len(own) // 4]] = True
    learn = np.flatnonzero(~held)
    scores, odds = _initial(units, [docs[i] for i in learn], y[learn])
    clean = np.unique(np.concatenate([np.empty(0, int), *[docs[i] for i in learn if y[i] == 0]]))
    if not len(clean):
        return None
    is_clean = np.zeros(len(units), bool)
    is_clean[clean] = True
    model, hard = None, np.empty(0, int)

    def few(windows: list[str]) -> list[str]:
        return windows if len(windows) <= CLEAN_WINDOWS else [windows[i] for i in rng.choice(len(windows), CLEAN_WINDOWS, replace=False)]

    def likeliest(unit: str) -> str:
        """The window of a toxic unit: by the model so far, at first by the pieces that toxic texts have."""
        own = _windows(unit)
        if len(own) == 1:
            return own[0]
        return own[int(np.argmax(model.window_scores(own) if model else [max(odds.get(g, -9.0) for g in _pieces(w)) for w in own]))]

    for _ in range(ROUNDS):
        odd = np.where(is_clean, -np.inf, scores)
        witness = Counter()
        for i in learn:
            if y[i] == 1 and len(docs[i]):
                best = docs[i][np.argsort(-odd[docs[i]])[:2]]
                witness.update(best[(odd[best] > 0) & (odd[best] >= odd[best].max() - 1)].tolist())
        good = np.array(list(witness), int)
        if not len(good):
            return model
        worst = [docs[i][np.argsort(-scores[docs[i]])[:3]] for i in learn if y[i] == 0 and len(docs[i])]
        hard = np.unique(np.concatenate([hard, *worst]))
        bad = np.unique(np.concatenate([hard, rng.choice(clean, min(len(clean), 6000), replace=False)]))
        some = [u for u, _ in witness.most_common(LANDMARKS * 2 // 3)]
        clean_windows = list(dict.fromkeys(w for i in bad for w in few(_windows(units[i]))))
        marks = [likeliest(units[i]) for i in some]
        marks += [clean_windows[i] for i in rng.choice(len(clean_windows), min(len(clean_windows), LANDMARKS - len(some)), replace=False)]
        windows = [likeliest(units[i]) for i in good] + clean_windows
        kernel = kernel_with(marks, marks)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        keep = values > 1e-6 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        target = np.array([1.0] * len(good) + [-1.0] * len(clean_windows))
        weight = np.concatenate([[witness[i] for i in good], np.ones(len(clean_windows))]).astype(float)
        weight[: len(good)] *= 0.3 * len(clean_windows) / weight[: len(good)].sum()
        w, bias = _svm(kernel_with(windows, marks) @ whiten, target, weight)
        alpha = (whiten @ w) / _norms(marks)
        table_ = np.zeros(_CODES)
        for row, code, decay in _subsequences(marks):
            np.add.at(table_, code, decay * alpha[row])
        model = Model(table_, bias)
        scores = model.unit_scores(units)
    top = np.array([scores[docs[i]].max() if len(docs[i]) else -5 for i in np.flatnonzero(held)])
    model.slope, model.shift = _platt(np.maximum(top, -5), y[held])
    return model


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the score, with smoothed targets; the slope stays positive."""
    if len(set(y.tolist())) < 2:
        return 4.0, 0.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, w = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (p - target) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.1), float(w[1])


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out. Rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0))


FITTED = "weights binary, bias double, slope double, shift double"


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model of the texts of one part, if it has texts of both labels."""
    labels: list[int] = []

    def texts() -> Iterator[str]:
        for batch in batches:
            labels.extend(batch.column("toxic").to_pylist())
            for text in batch.column("text"):
                yield text.as_py() or ""

    model = train(texts(), labels)
    if model is not None:
        yield pa.record_batch({"weights": pa.array([model.weights.tobytes()]), **{k: pa.array([getattr(model, k)], pa.float64()) for k in ("bias", "slope", "shift")}})


def learned(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model | None:
    """A model of at most ``sample`` labelled documents of each label that are not held out.

    The sample, one text of each of its ids, is read by one task, which keeps its words; the driver gets the weights.
    Labels other than 0 and 1 and null ids are left out; an id with both labels is toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by).limit(sample[1]).union(known.where("toxic = 0").orderBy(*by).limit(sample[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    fitted = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fit, FITTED).first()
    return fitted and Model(np.frombuffer(fitted.weights, float), fitted.bias, fitted.slope, fitted.shift)


_SCORES: dict[str, dict[str, float]] = {}


def scored(docs: DataFrame, model: Model | None, into: str = "__score") -> DataFrame:
    """``docs`` with the column ``into``, of every row and the whole text.

    A document scores as its most toxic unit. Null and empty texts get the score of no unit; without a model all score 0.
    """
    names = docs.columns
    assert into not in names
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = names.index("text")
    tag = f"{id(model)}-{np.random.default_rng().integers(1 << 62)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        if tag not in _SCORES:
            _SCORES.clear()
        known = _SCORES.setdefault(tag, {})
        for batch in batches:
            top = np.full(batch.num_rows, -5.0)
            for start in range(0, batch.num_rows, 500):
                if len(known) > KEPT_WORDS:
                    known.clear()
                words = []
                for text in batch.column(place)[start : start + 500]:
                    text = text.as_py() or ""
                    words.append(set(text.split()))
                    words[-1].update(spaced_units(text))
                new = list(set().union(*words).difference(known))
                if new:
                    units = [unit_of(w) for w in new]
                    each = np.full(len(new), -5.0)
                    has = np.flatnonzero([bool(u) for u in units])
                    if len(has):
                        each[has] = model.unit_scores([units[i] for i in has])
                    known.update(zip(new, each.tolist()))
                for i, own in enumerate(words):
                    if own:
                        top[start + i] = max(map(known.__getitem__, own))
            score = model.probability(top)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, into])

    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    return docs.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score is 0.5 or more; all columns stay, whatever their names.

    Null and empty texts stay, repeated rows are judged alike, an empty table gives none.
    """
    into = free_name(docs)
    return scored(docs, learned(docs, labels), into).where(F.col(into) < 0.5).drop(into)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents; null and empty texts get the score of no unit, rows
    without an id are held out, repeated rows score alike, an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, learned(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold() == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
