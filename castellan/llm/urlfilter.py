"""URL filters as an equi-join on expression hashes, DataFrame operations only.

A rule is a host and a path prefix. A URL expands into its host suffixes at
label borders times the prefixes of its path whose lengths occur among the
rules. Expressions and rules meet on the first four bytes of their SHA-256, the
whole digest confirms, and the longest rule wins; of rules equally long the one
with the longer host wins, then a block. Without a rule the verdict is allow.

Null URLs and URLs without ``://`` have an empty host and path and match
nothing. Repeated rows each get their verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules of the registered query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has verdict, host and path; rules with a null part are ignored.
    The lengths of rule paths are few and are gathered first, so any prefix is
    matched exactly, not only whole directories. Expressions join before pages
    do: URLs of one host and path expand once.
    """
    rules = rules.where("verdict is not null and host is not null and path is not null")
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).distinct()
    digest = F.sha2(F.concat(F.col("r_host"), F.lit("\n"), F.col("r_path")), 256)
    keyed = rules.select("verdict", "r_host", "r_path", digest.alias("r_digest"), F.substring(digest, 1, 8).alias("short"))
    lengths = rules.select(F.length("r_path").alias("n")).distinct().agg(F.array_sort(F.collect_list("n"))).first()[0] or []

    urls = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    urls = urls.select("__id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    urls = urls.select("__id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    places = urls.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    longest = F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(longest, lambda n: n <= F.length("path")), lambda n: F.expr("path").substr(F.lit(1), n))
    spread = places.select("host", "path", F.explode(suffixes).alias("e_host")).select("host", "path", "e_host", F.explode(prefixes).alias("e_path"))
    hashed = F.sha2(F.concat("e_host", F.lit("\n"), "e_path"), 256)
    spread = spread.select("host", "path", "e_host", "e_path", hashed.alias("e_digest"), F.substring(hashed, 1, 8).alias("short"))
    hits = spread.join(keyed, "short").where("e_digest = r_digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("verdict") == "block").cast("int").alias("b"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    joined = urls.join(best, (urls.host == best.b_host) & (urls.path == best.b_path), "left")
    return joined.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.page_id, p.host, p.path, r.h || r.q AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h) + length(r.q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
