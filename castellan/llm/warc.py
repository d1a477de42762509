"""Not-modified revisits resolved against the latest earlier full response.

Records carry ``record_id`` (long), ``url``, ``ts`` (long), ``kind``
(``response`` or ``revisit``), ``etag``, ``last_modified``, ``digest`` and
``headers`` (a map with lower-case names). A revisit takes the response of the
same canonical URL with the greatest earlier ``ts``, then the greatest
``record_id``; a response at the very time of the revisit is not earlier. Every
revisit row has one answer, also where record ids repeat: of responses that
share time and id, one is taken, the same for all.

The as-of join runs in three levels, since one URL may hold a third of all
records. Records of one URL and time fold first. A window then runs inside each
(URL, time bucket), which holds ``BUCKET`` different times at most, and a carry
of each bucket's latest response over the far fewer bucket summaries of a URL.

Outcomes: ``resolved`` when a validator both records have agrees (entity tag,
else modification date, else payload digest), ``mismatch`` when it differs,
``unverified`` when they share none, ``missing`` without an earlier response or
with a null URL or time. Only resolved revisits get headers: the response's,
updated by those that a not-modified answer may update. Records of another kind
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

BUCKET = 1024
#: Fixed header names that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical(url: str | Column) -> Column:
    """Host without case, default port and ``www.``; path without closing slashes; sorted query without ``utm_`` parameters; no scheme, no fragment."""
    u = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_replace(u, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(record_id, canonical_url, target_id, outcome, headers) of every revisit."""
    facts = records.select("record_id", canonical("url").alias("canonical_url"), "ts", "kind", "etag", "last_modified", "digest", "headers")
    # A number for each record, kept: record ids may repeat.
    facts = cut(facts.where("kind in ('response', 'revisit')").withColumn("rid", F.monotonically_increasing_id()))
    usable = facts.where("canonical_url is not null and ts is not null").select("canonical_url", "ts", "kind", "record_id", "rid")
    points = usable.groupBy("canonical_url", "ts").agg(F.max(F.when(F.col("kind") == "response", F.struct("record_id", "rid"))).alias("at"), F.bool_or(F.col("kind") == "revisit").alias("asked"))
    full = F.when(F.col("at").isNotNull(), F.struct("ts", F.col("at.rid").alias("rid")))
    points = points.withColumn("full", full).withColumn("bucket", F.floor(F.col("ts") / F.lit(bucket)))
    inside = W.partitionBy("canonical_url", "bucket").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    near = points.withColumn("near", F.max("full").over(inside)).where("asked").select("canonical_url", "ts", "bucket", "near")
    ends = points.groupBy("canonical_url", "bucket").agg(F.max("full").alias("end"))
    before = W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.max("end").over(before)).select("canonical_url", "bucket", "carried")
    found = near.join(carried, ["canonical_url", "bucket"], "left")
    found = found.select(F.col("canonical_url").alias("f_url"), F.col("ts").alias("f_ts"), F.coalesce("near", "carried")["rid"].alias("t_rid"))

    asks = facts.where("kind = 'revisit'")
    asks = asks.join(found, (asks.canonical_url == found.f_url) & (asks.ts == found.f_ts), "left").drop("rid", "kind", "ts", "f_url", "f_ts")
    target = facts.where("kind = 'response'").select(
        "rid", F.col("record_id").alias("target_id"), F.col("etag").alias("t_etag"), F.col("last_modified").alias("t_modified"), F.col("digest").alias("t_digest"), F.col("headers").alias("t_headers")
    )
    both = asks.join(target, asks.t_rid == target.rid, "left")
    bare = lambda c: F.regexp_replace(c, "^W/", "")  # noqa: E731  weak comparison
    agrees = F.coalesce(bare("etag") == bare("t_etag"), F.col("last_modified") == F.col("t_modified"), F.col("digest") == F.col("t_digest"))
    outcome = F.when(F.col("t_rid").isNull(), "missing").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own, theirs = F.coalesce("headers", empty), F.coalesce("t_headers", empty)
    news = F.map_filter(own, lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(news), k))
    return both.withColumn("outcome", outcome).select("record_id", "canonical_url", "target_id", "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, news)).alias("headers"))


#: Addresses that the pages of one host share, and the largest step from a response to its revisit.
SHARED, LATE = 40, 3_000


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records per page: its full response, and a later not-modified answer under another spelling of its URL.

    Two of three pages answer at an address that their host's pages share, so
    many responses lie before a revisit; the others at their own. Entity tag,
    modification date and payload digest take turns as the only validator, every
    fourth page has none, and every seventh answers with a tag of its own.
    """
    k = F.col("page_id")
    body = F.coalesce("html", F.lit(""))
    shared = F.concat(F.regexp_extract("url", r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/p"), F.pmod(k, F.lit(SHARED)).cast("string"))
    p = pages.select("page_id", F.when(F.pmod(k, F.lit(3)) == 0, F.col("url")).otherwise(shared).alias("url"), F.md5(body).alias("tag"), F.octet_length(body).cast("string").alias("size"))
    day = lambda c: F.concat(F.lit("day "), c.cast("string"))
    turn = F.pmod(k, F.lit(4))
    late = 2 * k + 1 + 2 * F.pmod(k * 37, F.when(F.pmod(k, F.lit(2)) == 0, F.lit(3)).otherwise(F.lit(LATE)))
    tag = F.when(turn == 0, F.when(F.pmod(k, F.lit(7)) == 0, F.lit("other")).otherwise(F.concat(F.lit("W/"), F.col("tag"))))
    dated, hashed = F.when(turn == 1, F.col("tag")), F.when(turn == 2, F.col("tag"))
    responses = p.select(
        (k * 2).alias("record_id"), "url", (2 * k).alias("ts"), F.lit("response").alias("kind"), F.when(turn == 0, F.col("tag")).alias("etag"), dated.alias("last_modified"), hashed.alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size"), F.lit("etag"), F.col("tag"), F.lit("date"), day(2 * k)).alias("headers"),
    )
    revisits = p.select(
        (k * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTP://www."), F.lit("#again")).alias("url"), late.alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), dated.alias("last_modified"), hashed.alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), F.col("tag"), F.lit("date"), day(late)).alias("headers"),
    )
    return responses.union(revisits)


def report(pages: DataFrame) -> DataFrame:
    h = F.col("headers")
    return resolve(records_of_pages(pages)).select("record_id", "canonical_url", "target_id", "outcome", h["content-type"].alias("content_type"), h["content-length"].alias("content_length"), h["etag"].alias("etag"), h["date"].alias("date"))


def _oracle_canonical(url: str) -> str:
    rest = f"regexp_replace({url}, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/?#]*)', 1)), '^www\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '/+$', '')"
    params = f"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')))"
    return f"{host} || {path} || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"


_SHARED = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/p' || CAST(page_id % 40 AS VARCHAR)"
ORACLE = f"""
WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 3 = 0 THEN url ELSE {_SHARED} END AS url, md5(coalesce(html, '')) AS tag, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
s AS (SELECT k * 2 AS record_id, {_oracle_canonical("url")} AS c, 2 * k AS ts, CASE WHEN k % 4 = 0 THEN tag END AS etag, CASE WHEN k % 4 = 1 THEN tag END AS modified, CASE WHEN k % 4 = 2 THEN tag END AS digest, size FROM p),
v AS (SELECT k * 2 + 1 AS record_id, {_oracle_canonical("regexp_replace(url, '^https?://', 'HTTP://www.') || '#again'")} AS c, tag,
      2 * k + 1 + 2 * (k * 37 % CASE WHEN k % 2 = 0 THEN 3 ELSE 3000 END) AS ts,
      CASE WHEN k % 4 = 0 THEN CASE WHEN k % 7 = 0 THEN 'other' ELSE tag END END AS etag, CASE WHEN k % 4 = 1 THEN tag END AS modified, CASE WHEN k % 4 = 2 THEN tag END AS digest FROM p),
j AS (SELECT v.record_id, v.c, v.ts, v.tag, v.etag, v.modified, v.digest, s.record_id AS target_id, s.etag AS s_etag, s.modified AS s_modified, s.digest AS s_digest, s.size FROM v ASOF LEFT JOIN s ON v.c = s.c AND v.ts > s.ts),
o AS (SELECT *, CASE WHEN target_id IS NULL THEN 'missing' WHEN coalesce(etag = s_etag, modified = s_modified, digest = s_digest) IS NULL THEN 'unverified'
      WHEN coalesce(etag = s_etag, modified = s_modified, digest = s_digest) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT record_id, c AS canonical_url, target_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN outcome = 'resolved' THEN size END AS content_length,
  CASE WHEN outcome = 'resolved' THEN tag END AS etag, CASE WHEN outcome = 'resolved' THEN 'day ' || CAST(ts AS VARCHAR) END AS date
FROM o
"""
