"""URL filters by host-suffix and path-prefix expressions with short hash prefixes (operator 9, built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path) as the contract gives them.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: What the method says where no rule fits: a URL no rule names is let through.
DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? or #. Both empty without ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.when(at > 0, F.regexp_extract(rest, r"\A([^/?#]*)", 1)).otherwise("")
    path = F.when(at > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(host, F.lit("")), _UP, _LOW), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules with their digest, its short prefix and the shape that an expression needs: labels of the host, length of the path."""
    rows = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat_ws("\x00", "rule_host", "rule_path"), 256)
    return rows.select(
        "verdict", F.concat("rule_host", "rule_path").alias("rule"), digest.alias("digest"),
        F.substring(digest, 1, PREFIX_HEX).alias("prefix"),
        F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"),
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    Each URL gives an expression for each shape (labels, path length) that a rule has, so the expressions of a URL are as
    many as the shapes and not as the rules. They meet the rules by an equi-join on short prefixes of their SHA-256, then
    the whole digest is compared, and the longest rule wins (equal lengths: the greater host first, then block).
    Null or odd URLs have an empty host and path and get the default; repeated rows each return; columns beside page_id
    and url are not read.
    """
    spark = pages.sparkSession
    table_ = rule_table(spark, rules)
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    host, path = url_parts(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    expressions = F.array(*[
        F.when(
            (F.size(labels) >= n) & (F.length("path") >= k),
            F.sha2(F.concat_ws("\x00", F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), "."), F.substring("path", 1, k)), 256),
        )
        for n, k in shapes
    ])
    asked = urls.select("host", "path").distinct().withColumn("own", F.explode(F.array_compact(expressions)))
    asked = asked.withColumn("prefix", F.substring("own", 1, PREFIX_HEX))
    hits = asked.join(table_, "prefix").where("own = digest")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "labels", "verdict", "rule")).alias("best"))
    found = urls.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages; a null url has an empty host and path, repeated rows each return, an empty table gives none."""
    return judge(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH u AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
v AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rule_host, rule_path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT page_id, host, path, verdict, rule_host || rule_path AS rule,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM v JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT v.page_id, v.host, v.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM v LEFT JOIN f ON v.page_id = f.page_id AND v.host = f.host AND v.path = f.path AND f.n = 1
"""
