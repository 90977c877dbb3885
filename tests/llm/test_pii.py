import hashlib
import re

from rillflow.llm import pii

KINDS = pii.KINDS


def slow(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    out.sort()
    return out, [sum(k == i for _, k, _ in out) for i in range(4)], hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in out).encode()).hexdigest()


CASES = [
    None, "", "é a.b@c.d.e, x@y", "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.02.3.255", "4539 1488 0343 6467 4539148803436468 4539-1488-0343-6467", "+1 (017) 555-7713 +12 3 +1234567890123456",
    "@" * 500, "1 " * 300, "mail a@b.co or b@c.org. call +49 30 1234567", "٣٣.1.1.1 ١",
]


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, CASES[8], None), (8, CASES[8], "again"), (99, "pad 10.0.0.1 " * 4000, "")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows} | {None: CASES[8]}
    for r in got:
        spans, counts, digest = slow(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in spans} <= set(r.spans.split(",") if r.spans else [])


def test_learned_forms(spark):
    rows = [(i, f"text {i} mail user{i}@host{i % 7}.example.com and call +1 ({i % 900 + 100}) 555-{1000 + i} from 10.{i % 250}.3.{i % 200}") for i in range(300)]
    rows += [(1000 + i, f"order {7919 * i % 100000} and at home {i} dots, build {i}.{i}") for i in range(300)]
    rows += [(5000, "write to jane.roe (at) mail3 dot example dot org please"), (5001, "nothing at all dotted here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert got[5000].spans.startswith("email:9:") and got[5001].spans == ""
    assert sum(got[1000 + i].n_added for i in range(300)) <= 6
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_addresses_as_the_plain_pattern_finds_them():
    plain = pii.re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = pii.np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab.@-_ é1"), 24))
        assert pii.emails(text) == [m.span() for m in plain.finditer(text)]
        ip = "".join(rng.choice(list("12. "), 24))
        assert [m.span() for m in pii.IP.finditer(ip)] == [m.span() for m in pii.re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ip)]


def test_very_long_runs_end_in_time():
    for text in ("7" * 1_000_000, "a" * 1_000_000 + "@", "a" * 500_000 + "@b", "1." * 300_000, "+1" + " " * 500_000):
        pii.candidates_of(text, pii.base_spans(text))
