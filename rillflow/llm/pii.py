"""Personal data by candidate generation and gradient-boosted trees with calibrated thresholds (operator 2)."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, cut, row_key, table
from .spans import ARROW_SPAN, SPAN, Taken, base_digest, spans_text

KINDS = ["email", "ip", "card", "phone"]
# Fixed patterns of the contract. An e-mail address is what _LOCAL and _DOMAIN have on either side of an @; an IP starts
# where its digits start, as the pattern without that finds the same and takes the square of a long run's length.
_LOCAL, _DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# High-recall generators (a local part has 64 characters at most and a label 63, by the standard): written-out and broken forms of the same kinds.
_AT, _DOT = r"(?:@|\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?)", r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?)"
GENERATORS = [
    (0, re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+", re.I)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9](?:[\x20().\x2F-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])")),
]
#: A cheap test that a text can hold any candidate at all: each generator needs one of these.
_ANY = re.compile(r"@|[0-9]|(?i:[\[({ ]at[\])} ])")
_CONTEXT = re.compile(r"\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|cell|card|visa|credit|iban|ip|host|addr|address|server)\b", re.I)
_CODE = re.compile(r"(?:version|ver|id|no|isbn|token|key|order|ref|build|sha|hash)[\x20:=#.]*$", re.I)
#: Training candidates of each kind and label at most, chosen by a hash; trees and their depth; precision to calibrate to.
#: One of FOLDS parts by hash is held out; its scores are counted in BINS, a power of two so that bin edges are exact.
FOLDS, BINS = 3, 1024
SAMPLE, TREES, DEPTH, PRECISION = 2000, 20, 4, 0.97


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping addresses in time linear in the text: from each @ back to where its local part starts."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping for each kind; failing matches are dropped, without retries."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


FEATURES = ["kind", "length", "digits", "letters", "blanks", "dots", "dashes", "brackets", "plus", "at", "written", "groups", "longest", "luhn", "octets", "distinct", "glued", "keyword", "code", "tail", "hexlike"]


def features(kind: int, value: str, before: str, after: str) -> list[float]:
    """Format and context of a candidate, in the order of FEATURES."""
    digits = [c for c in value if c.isdigit()]
    groups = re.findall(r"[0-9]+", value)
    low = value.lower()
    tail = re.findall(r"[a-z]+", low)
    return [
        kind, len(value), len(digits), sum(c.isalpha() for c in value), value.count(" "), value.count("."), value.count("-") + value.count("/"),
        value.count("(") + value.count("["), float(value[0] == "+"), float("@" in value), float(" at " in low or "at]" in low or "at)" in low) + float(" dot " in low or "dot]" in low or "dot)" in low),
        len(groups), max(map(len, groups), default=0), float(bool(digits) and luhn("".join(digits))), float(bool(groups) and all(int(g[:4]) <= 255 for g in groups)),
        len(set(digits)), float(bool(before) and (before[-1].isalnum() or before[-1] in "@_.")) + float(bool(after) and (after[0].isalnum() or after[0] in "@_")),
        float(bool(_CONTEXT.search(before[-40:]))), float(bool(_CODE.search(before[-16:]))), len(tail[-1]) if tail else 0, float(bool(re.search(r"[0-9a-f]{6}$", before)) or bool(re.match(r"[0-9a-f]{6}", after))),
    ]


def _overlap(a: int, b: int, x: int, y: int) -> float:
    return max(0, min(b, y) - max(a, x)) / (max(b, y) - min(a, x))


#: Ways to write @ and . of an address, all of which the generator reads.
_AT_FORMS = [" at ", " (at) ", "(at)", "[at]", " [at] ", "{at}"]
_DOT_FORMS = [" dot ", ".", "[dot]", " (dot) "]


def disguised(kind: int, value: str) -> str:
    """The same datum written so that the strict rules miss it; the trees learn such forms from it. Which form is left to a
    hash of the value."""
    if kind == 0:
        form = crc32(value.encode())
        local, _, domain = value.partition("@")
        return local + _AT_FORMS[form % len(_AT_FORMS)] + domain.replace(".", _DOT_FORMS[form // 7 % len(_DOT_FORMS)])
    if kind == 1:
        return value.replace(".", "[.]")
    if kind == 2:
        digits = re.sub(r"\D", "", value)
        return ("." if len(value) % 2 else "  ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return re.sub(r"^\+[0-9]{1,3}[\x20.-]*", "", value) if len(value) % 2 else value.replace("+", "00", 1)


CANDIDATE = "struct<start:int,kind:int,end:int,made:int,label:int,fresh:int,x:array<float>>"
SCANNED = f"key string, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, candidates array<{CANDIDATE}>"
_CANDIDATE = pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "made", "label", "fresh")] + [("x", pa.list_(pa.float32()))])


def candidates_of(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Generated spans with features; label is 1 where a base span of the kind covers the same place. ``made`` rows are
    disguised copies of base spans in their own context, for training only."""
    out = []
    if not _ANY.search(text):
        return out
    covered = Taken((a, b) for a, _, b in base)
    for kind, pattern in GENERATORS:
        own = Taken((a, b) for a, k, b in base if k == kind)
        for m in pattern.finditer(text):
            a, b = m.span()
            met = own.meeting(a, b)
            same = met is not None and _overlap(a, b, *met) > 0.8
            out.append({"start": a, "kind": kind, "end": b, "made": 0, "label": int(same), "fresh": int(covered.meeting(a, b) is None), "x": features(kind, m[0], text[max(0, a - 40) : a], text[b : b + 8])})
    for a, kind, b in base:
        form = disguised(kind, text[a:b])
        if GENERATORS[kind][1].fullmatch(form):
            out.append({"start": a, "kind": kind, "end": b, "made": 1, "label": 1, "fresh": 0, "x": features(kind, form, text[max(0, a - 40) : a], text[b : b + 8])})
    return out


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    base, found = [], []
    for text in batch.column("text"):
        text = text.as_py() or ""
        base.append(base_spans(text))
        found.append(candidates_of(text, base[-1]))
    counts = {f"n_{k}": pa.array([sum(x == i for _, x, _ in own) for own in base], pa.int64()) for i, k in enumerate(KINDS)}
    return pa.record_batch({
        "key": batch.column("key"), "doc_id": batch.column("doc_id"), **counts, "base_sha256": pa.array([base_digest(own, KINDS) for own in base]),
        "base": pa.array([[dict(zip(("start", "kind", "end"), s)) for s in sorted(own)] for own in base], pa.list_(ARROW_SPAN)),
        "candidates": pa.array(found, pa.list_(_CANDIDATE)),
    })


def trained(candidates: DataFrame, sample: int = SAMPLE) -> tuple[GBTClassificationModel | None, dict[int, float]]:
    """Boosted trees, from at most ``sample`` candidates of each kind, origin and label, and the threshold of each kind.

    Labels come from the strict rules (distant supervision). A part of all candidates, by a hash of their place, is not
    learned from: all of it is scored, so the mix of labels is that of the data at any size (a disguised copy counts
    once for its span), and the threshold of a kind is the least score bin from which on PRECISION of its candidates are
    right; a kind that never gets there adds nothing.
    """
    folded = candidates.withColumn("fold", F.pmod(F.xxhash64("key", "start"), F.lit(FOLDS)))
    order = [F.xxhash64("key", "start", "kind", "made"), F.col("key"), F.col("start")]
    parts = [
        folded.where(f"fold <> 0 and kind = {k} and made = {made} and label = {label}").orderBy(*order).limit(sample)
        for k in range(len(KINDS)) for made, label in ((0, 0), (0, 1), (1, 1))
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    rows = cut(rows.select("label", "x").coalesce(2))
    learn = rows.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    if learn.select("label").distinct().count() < 2:
        return None, {}
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, maxBins=64, stepSize=0.2, cacheNodeIds=False).fit(learn)
    return model, thresholds(_probabilities(folded.where("fold = 0").select("kind", "label", "x"), model))


def thresholds(scored: DataFrame) -> dict[int, float]:
    """The threshold of each kind from all rows of ``scored`` (kind, label, p); only counts of bins reach the driver."""
    score_bin = F.floor(F.col("p") * BINS).cast("int")
    counts = scored.groupBy("kind", score_bin.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("right")).toArrow().to_pydict()
    kind, at, n, right = (np.array(counts[c], np.int64) for c in ("kind", "bin", "n", "right"))
    limits = {}
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-at[own])]
        good = np.flatnonzero(right[own].cumsum() >= PRECISION * n[own].cumsum())
        if len(good):
            limits[k] = max(0.5, float(at[own][good[-1]]) / BINS)
    return limits


def _probabilities(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
    made = rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    return model.transform(made).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def best_first(chosen: DataFrame) -> DataFrame:
    """(key, added): the found spans of each key from the best score down, without those that overlap what is taken."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for found in batch.column("found").to_pylist():
            taken, own = Taken(), []
            for c in sorted(found, key=lambda c: (-c["p"], c["start"], c["kind"], c["end"])):
                if taken.meeting(c["start"], c["end"]) is None:
                    taken.add(c["start"], c["end"])
                    own.append({n: c[n] for n in ("start", "kind", "end")})
            out.append(own)
        return pa.record_batch({"key": batch.column("key"), "added": pa.array(out, pa.list_(ARROW_SPAN))})

    return by_batches(chosen, fn, f"key string, added array<{SPAN}>")


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``.

    Base spans always stay. Of the generated spans that meet no base span, those whose calibrated score passes the kind's
    threshold are added, the best first, none overlapping another. Null texts count as empty; null doc_ids keep their
    row; rows with equal doc_id and text get equal results; other columns aren't read.
    """
    plain = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned = cut(by_batches(plain, _scan, SCANNED))
    once = scanned.where("size(candidates) > 0").select("key", "candidates").dropDuplicates(["key"])
    candidates = cut(once.select("key", F.inline("candidates")))
    model, limits = trained(candidates)
    kinds = F.concat("base", F.coalesce("added", F.expr(f"cast(array() as array<{SPAN}>)")))
    if limits:
        fresh = candidates.where("fresh = 1")
        passed = F.lit(False)
        for k, limit in limits.items():
            passed = passed | ((F.col("kind") == k) & (F.col("p") >= limit))
        chosen = _probabilities(fresh, model).where(passed)
        added = best_first(chosen.groupBy("key").agg(F.collect_list(F.struct("p", "start", "kind", "end")).alias("found")))
        joined = scanned.join(added, "key", "left")
    else:
        joined = scanned.withColumn("added", F.expr(f"cast(null as array<{SPAN}>)"))
    return joined.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans_text(kinds, KINDS).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_pii of documents; an empty table gives none."""
    return find_pii(table(spark, sf_dir, "documents"))
