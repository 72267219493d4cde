"""URL filters: host-suffix and path-prefix expressions joined to rules by hash.

A URL is expanded into the host suffixes and path prefixes that a rule could have: the
pairs of a label count and a path length that occur together among the rules. Expressions
meet rules in an equi-join on the first hex digits of their SHA-256; the full digest is
compared behind the join, then the longest rule wins. Ties go to the longer host, then to block.

Defined results: a URL that is null or has no ``://`` has empty host and path and
fits no rule; URLs that fit no rule get ``default``; each input row gives one row,
repeated rows too. Large rule tables meet by a sort-merge join, whose hot keys
adaptive execution splits; small ones are broadcast by their measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.llm.tables import table

PREFIX = 8  # hex digits of the join key
DEFAULT = "allow"
# The rules of the query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, url, host, path, rule, verdict), one row for each row of ``pages``."""
    bad = rules.where(~F.col("path").startswith("/") | F.col("host").contains("/") | ~F.col("verdict").isin("allow", "block")).head(1)
    if bad:
        raise ValueError(f"not a rule: {bad[0]}")
    # Shapes: pairs of small integers, however many rules there are.
    shapes = sorted(tuple(r) for r in rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect())
    urls = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("rows"))
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parts = F.split("host", r"\.")
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in shapes])
    able = F.filter(listed, lambda s: (F.size(parts) >= s["n"]) & (F.length("path") >= s["k"])) if shapes else None
    pairs = F.transform(able, lambda s: F.struct(F.array_join(F.slice(parts, -s["n"], s["n"]), ".").alias("h"), F.col("path").substr(F.lit(1), s["k"]).alias("p"))) if shapes else None
    tries = urls.withColumn("try", F.explode_outer(pairs) if shapes else F.lit(None).cast("struct<h:string,p:string>"))
    tries = tries.withColumn("digest", F.sha2(F.concat("try.h", "try.p").cast("binary"), 256)).withColumn("key", F.substring("digest", 1, PREFIX))
    book = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), F.col("verdict").alias("says")).distinct()
    book = book.withColumn("full", F.sha2(F.col("rule").cast("binary"), 256)).withColumn("short", F.substring("full", 1, PREFIX))
    met = tries.join(book, F.col("key") == F.col("short"), "left")
    best = F.max(F.when(F.col("digest") == F.col("full"), F.struct(F.length("rule").alias("size"), "host_size", "says", "rule"))).alias("best")
    out = met.groupBy("page_id", "url", "rows", "host", "path").agg(best)
    out = out.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"))


def op8_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(h, q, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), f AS (
  SELECT page_id, url, h || q AS rule, v,
         row_number() OVER (PARTITION BY page_id, url ORDER BY length(h || q) DESC, length(h) DESC, v DESC) AS n
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.url = p.url AND f.n = 1
"""
