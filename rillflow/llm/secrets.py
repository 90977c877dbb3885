"""Secret scan with multipart credential linking (operator 1)."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, cut, row_key, table
from .spans import ARROW_SPAN, SPAN, Taken, base_digest, spans_text

#: The three base kinds, then those that linking adds.
KINDS = ["assign", "access", "hex", "identifier", "credential", "endpoint"]
# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ of 24 and more
# Weak parts. None is reported alone.
IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?(?:key_?)?id|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
CREDENTIAL = re.compile(r"""\b(?:pwd|passphrase|pass|auth|credentials?|signature|private_?key|access_?key|key|pin)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=~!@#$%^&*-]{6,})""", re.I | re.A)
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>|]{3,}|(?:host(?:name)?|endpoint|server|bucket|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/-]{3,})""", re.I | re.A)
#: Parts link with at most so many code points between them in one scope (a run of lines without a blank one).
REACH = 300
_BLANK = re.compile(r"\n[ \t\r]*\n")
# Roles of a part.
ID, SECRET, PLACE = 0, 1, 2


def _opaque(value: str) -> bool:
    """Random looking: digits, both cases, and at least 3.5 bits a character."""
    if not (any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= 3.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping for each kind, failing matches dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(*m.span()[:1], 2, m.end()) for m in HEX.finditer(text)]


def parts_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(scope, role, start, kind, end) of all parts of a credential, base spans among them; weak ones never overlap base."""
    parts = [(ID if k == 1 else SECRET, a, k, b) for a, k, b in base]
    taken = Taken((a, b) for a, _, b in base)

    def free(a: int, b: int) -> bool:
        return taken.meeting(a, b) is None

    for pattern, role, kind in ((IDENTIFIER, ID, 3), (CREDENTIAL, SECRET, 4), (ENDPOINT, PLACE, 5)):
        parts += [(role, m.start(), kind, m.end()) for m in pattern.finditer(text) if free(*m.span())]
    parts += [(SECRET, m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if _opaque(m[0]) and free(*m.span())]
    if len(parts) < 2:
        return []
    blanks = [m.start() for m in _BLANK.finditer(text)]
    out, at = [], 0
    for role, a, k, b in sorted(parts, key=lambda p: p[1]):
        while at < len(blanks) and blanks[at] < a:
            at += 1
        out.append((at, role, a, k, b))
    return out


SCANNED = f"key string, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<{SPAN}>, parts array<struct<scope:int,role:int,start:int,kind:int,end:int>>"
_PART = pa.struct([(n, pa.int32()) for n in ("scope", "role", "start", "kind", "end")])


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    base, parts = [], []
    for text in batch.column("text"):
        text = text.as_py() or ""
        base.append(base_spans(text))
        parts.append(parts_of(text, base[-1]))
    count = lambda kind: pa.array([sum(k == kind for _, k, _ in own) for own in base], pa.int64())
    names = ("scope", "role", "start", "kind", "end")
    return pa.record_batch({
        "key": batch.column("key"), "doc_id": batch.column("doc_id"), "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
        "base_sha256": pa.array([base_digest(own, KINDS) for own in base]),
        "base": pa.array([[dict(zip(("start", "kind", "end"), s)) for s in sorted(own)] for own in base], pa.list_(ARROW_SPAN)),
        "parts": pa.array([[dict(zip(names, p)) for p in own] for own in parts], pa.list_(_PART)),
    })


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, span) of the weak parts that complementary parts confirm.

    ``parts``: key, scope, role, start, kind, end. An interval join on cells of ``reach`` code points pairs each secret
    with the identifiers and endpoints of its scope that have at most ``reach`` code points between them; a part is in
    each cell that it covers, and others reach a cell further on both sides. A weak identifier or endpoint is confirmed
    by any secret, a weak secret by an identifier or an endpoint. A cell holds few parts, since parts of a role do not
    overlap.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / reach).cast("int"), F.floor(high / reach).cast("int")))
    secrets = parts.where(f"role = {SECRET}").select("key", "scope", cells(F.col("start"), F.col("end")).alias("cell"), *[F.col(c).alias(f"s_{c}") for c in ("start", "kind", "end")])
    others = parts.where(f"role <> {SECRET}").withColumn("cell", cells(F.col("start") - reach, F.col("end") + reach))
    pairs = others.join(secrets, ["key", "scope", "cell"]).where(f"greatest(start, s_start) - least(end, s_end) <= {reach}")
    both = pairs.select("key", F.explode(F.array(F.struct("start", "kind", "end"), F.struct(F.col("s_start").alias("start"), F.col("s_kind").alias("kind"), F.col("s_end").alias("end")))).alias("span"))
    return both.where("span.kind >= 3").distinct()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for each row of ``docs``.

    Base spans always stay; linking adds weak parts of credentials that co-occur. Null texts count as empty; null
    doc_ids keep their row; rows with equal doc_id and text get equal results; other columns aren't read.
    """
    plain = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned = cut(by_batches(plain, _scan, SCANNED))
    parts = scanned.select("key", "parts").dropDuplicates(["key"]).select("key", F.inline("parts"))
    linked = link_parts(parts).groupBy("key").agg(F.collect_list("span").alias("linked"))
    joined = scanned.join(linked, "key", "left")
    every = F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as array<{SPAN}>)")))
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text(every, KINDS).alias("spans"),
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets of documents; an empty table gives none."""
    return scan_secrets(table(spark, sf_dir, "documents"))
