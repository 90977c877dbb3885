import hashlib
import re

from rillflow.llm import secrets
from rillflow.llm.secrets import scan_secrets

KINDS = ["assign", "access", "hex"]


def slow(text):
    text = text or ""
    out = [("assign", m) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out = sorted((m.start(), KINDS.index(k), m.end()) for k, m in out)
    return out, [sum(k == i for _, k, _ in out) for i in range(3)], hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out).encode()).hexdigest()


CASES = [
    None, "", "password = token: abcdefgh", "PassWord='abcdef' x", "é token=short api_key:  \"abc/def+\"", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "x" + "0a" * 12 + "g" + "f" * 23,
    "secret=" + "ab" * 20 + " token = 'x.y.z-1'", "paſſword=abcdefgh", "toKen=abcdefgh", "passwd:" + "deadbeef" * 9000,
]


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, CASES[3], None), (3, CASES[3], "again")]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()
    assert len(got) == len(rows)
    for r in got:
        spans, counts, digest = slow(CASES[3 if r.doc_id is None else r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == digest
        listed = r.spans.split(",") if r.spans else []
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in spans} <= set(listed)


def test_weak_parts_need_each_other(spark):
    alone = "user = alice9 and nothing else"
    secret = "auth: hunter22x"
    far = alone + " z" * 400 + secret
    scoped = alone + "\n\n" + secret
    together = alone + " " + secret
    place = "host=db.internal:5432 pwd=s3cretpass"
    docs = spark.createDataFrame(list(enumerate([alone, secret, far, scoped, together, place])), "doc_id long, text string")
    linked = {r.doc_id: r.spans for r in scan_secrets(docs).collect()}
    assert [linked[i] for i in range(4)] == [""] * 4
    assert linked[4] == f"identifier:0:13,credential:{len(alone) + 1}:{len(together)}"
    assert linked[5] == f"endpoint:0:21,credential:22:{len(place)}"
    assert scan_secrets(docs.limit(0)).count() == 0


def test_links_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    parts = []
    for key in ("a", "b", "c"):
        for scope in range(4):
            at = 0
            for _ in range(int(rng.integers(0, 14))):
                at += int(rng.integers(1, 500))
                end = at + int(rng.choice([5, 30, 900]))
                role = int(rng.integers(3))
                parts.append((key, scope, role, at, {0: int(rng.choice([1, 3])), 1: int(rng.choice([0, 4])), 2: 5}[role], end))
                at = end
    want = set()
    for k, s, r, a, kind, b in parts:
        for k2, s2, r2, x, kind2, y in parts:
            if (k, s) == (k2, s2) and (r == 1) != (r2 == 1) and max(a, x) - min(b, y) <= 300 and kind >= 3:
                want.add((k, a, kind, b))
    df = spark.createDataFrame(parts, "key string, scope int, role int, start int, kind int, end int")
    got = {(r.key, r.span.start, r.span.kind, r.span.end) for r in secrets.link_parts(df).collect()}
    assert got == want and len(want) > 20


def test_values_run_to_their_end():
    text = "user=jane pwd=" + "k" * 600 + "9"
    assert any(k == 4 and b == len(text) for _, _, _, k, b in secrets.parts_of(text, secrets.base_spans(text)))
