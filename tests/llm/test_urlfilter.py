import duckdb

from rillflow.llm.urlfilter import ORACLE_SQL, judge

#: (verdict, host, path), written out here so that the library's rules are held against them.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_against_brute_force(spark):
    urls = [
        None, "", "no scheme/en/", "http://", "https://EXAMPLE.com/en/7", "http://a.b.example.com/en/77?x#y", "http://example.com/en/8", "http://xexample.com/en/7",
        "ftp://example.net/de/8", "http://net/de/", "http://a.net?/de/", "http://a.org/es", "http://a.org/es/#", "http://.com/en/", "http://com./en/", "x://y://com/en/",
        "http://a.com/EN/7", "http://a.com\n/en/7", "http://É.COM/en/7", "http://a..com/en/" + "z" * 50_000,
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[4], None), (4, urls[4], "again")], "page_id long, url string, rule string")
    got = sorted(map(tuple, judge(pages).collect()), key=str)
    want = [(i, *slow(u)) for i, u in enumerate(urls)] + [(None, *slow(urls[4])), (4, *slow(urls[4]))]
    assert got == sorted(want, key=str)
    assert judge(pages.limit(0)).count() == 0


def test_verdict_of_each_rule(spark):
    want = {
        "http://shop.com/en/1": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"), "http://shop.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://x.example.net/de/80": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"),
        "http://a.org/en/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in judge(pages).collect()} == dict(enumerate(want.values()))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {r[0]: (r[3], r[4]) for r in con.execute(ORACLE_SQL).fetchall()} == dict(enumerate(want.values()))
