"""Resolving not-modified revisits of a web archive.

A revisit record with status 304 carries no payload. It is joined, as of its time, to the latest earlier full response of
the same canonical URL; the validators of both decide whether the response still stands, and the headers that a 304 may
update are merged into the response's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import cut, table

#: Headers of a 304 that replace the stored ones (RFC 9110, 15.4.5, and Last-Modified), lower-cased.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Blocks that the records' times are cut into, so that one URL's records are not one task's.
BLOCKS = 64


def canonical_url(url: F.Column) -> F.Column:
    """Scheme http and https alike, host lower-cased without `www.` and default port, no fragment, no tracking
    parameters, no `/` at the end; null for null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[.]", "")
    tail = F.regexp_extract(rest, "^[^/?]*(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "([?&])(?:utm_[a-z]+)=[^&]*", "$1"), "&+", "&"), "[?]&", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(query, "[?&]+$", ""), "/+$", ""))


def lower_keys(headers: F.Column) -> F.Column:
    """Header names in lower case; of names that then clash the greatest value stays."""
    items = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(items, lambda e, i: F.get(items, i + 1)["key"].isNull() | (F.get(items, i + 1)["key"] != e["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def strong(tag: F.Column) -> F.Column:
    """An entity tag for the weak comparison that conditional requests use."""
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row for each revisit of records(record_id, url, ts, kind, status, headers, digest, length).

    kind is `response` or `revisit`; a full response has kind response and status 200. Earlier means a smaller (ts,
    record_id). Returns (record_id, url, canonical, ts, verdict, response_id, response_ts, headers, digest, length). The
    verdict is

    - `resolved`: the entity tags agree, weakly compared, or without a tag in the revisit the modification times do;
    - `unvalidated`: the revisit has neither; it is taken to stand for the response;
    - `mismatch`: a validator of the revisit is missing from or other than the response's;
    - `no_response`: there is no earlier full response.

    For the first two the response's headers, updated by the permitted ones of the revisit, and its digest and length are
    returned, else the revisit's own headers and nulls. Header names are lower-cased.

    A revisit with a null url or ts has no response; a response with either is never found. Null headers are empty.
    Repeated rows are each resolved. An empty table gives no rows. Other columns are not read. Payloads are not moved.
    """
    is_response = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    d = records.select("record_id", "url", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "status", lower_keys(F.col("headers")).alias("headers"), "digest", "length")
    d = d.filter((F.col("kind") == "revisit") | is_response)
    d = d.withColumn("full", F.when(is_response, F.struct(F.col("record_id").alias("response_id"), F.col("ts").alias("response_ts"), F.col("headers").alias("response_headers"), F.col("digest").alias("response_digest"), F.col("length").alias("response_length"))))
    bounds = records.agg(F.percentile_approx(F.col("ts").cast("double"), [i / BLOCKS for i in range(1, BLOCKS)], 1000)).first()[0] or []
    block = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<double>"), lambda x: x <= F.col("ts").cast("double")))
    d = d.withColumn("block", F.when(F.col("ts").isNull(), -1).otherwise(block))
    # no payload is in here, so a record is small; URLs that no record has stay apart
    d = d.withColumn("key", F.coalesce("canonical", F.concat(F.lit("\x00"), F.col("record_id").cast("string")), F.lit("\x00")))
    inside = Window.partitionBy("key", "block").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("found", F.last("full", ignorenulls=True).over(inside))
    newest = d.filter("full is not null").groupBy("key", "block").agg(F.max_by("full", F.struct("ts", "record_id")).alias("newest"))
    # the last response of any block before: one row for each URL and block, BLOCKS at most
    blocks = d.filter("kind = 'revisit'").select("key", "block").distinct().join(newest, ["key", "block"], "full")
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("key", "block", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    r = d.filter("kind = 'revisit'").join(carried, ["key", "block"], "left")
    r = r.withColumn("hit", F.when(F.col("canonical").isNotNull() & F.col("ts").isNotNull(), F.coalesce("found", "carried")))
    own, old = F.col("headers"), F.col("hit.response_headers")
    tag, changed = own["etag"], own["last-modified"]
    same_tag = F.coalesce(strong(tag) == strong(old["etag"]), F.lit(False))
    same_time = F.coalesce(changed == old["last-modified"], F.lit(False))
    verdict = (
        F.when(F.col("hit").isNull(), "no_response")
        .when(tag.isNotNull(), F.when(same_tag, "resolved").otherwise("mismatch"))
        .when(changed.isNotNull(), F.when(same_time, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    r = r.withColumn("verdict", verdict).withColumn("stands", F.col("verdict").isin("resolved", "unvalidated"))
    update = F.map_filter(own, lambda k, v: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    return r.select(
        "record_id", "url", "canonical", "ts", "verdict",
        F.when(F.col("stands"), F.col("hit.response_id")).alias("response_id"),
        F.when(F.col("stands"), F.col("hit.response_ts")).alias("response_ts"),
        F.when(F.col("stands"), merged).otherwise(own).alias("headers"),
        F.when(F.col("stands"), F.col("hit.response_digest")).alias("digest"),
        F.when(F.col("stands"), F.col("hit.response_length")).alias("length"),
    )


def header_text(headers: F.Column) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl over the pages: each page's full response; a day later a 304 under another form of the URL, with headers
    that differ by page; an hour before it, for every fifth page, a 304 that nothing may precede."""
    start = (F.lit(1_700_000_000) + F.col("page_id") * 7919 % 1_000_003).cast("long")
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.md5(html)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    changed = F.concat(F.lit("t"), start.cast("string"))
    kind = F.pmod(F.col("page_id"), F.lit(7))
    base = pages.select("page_id", "url", start.alias("start"), digest.alias("digest"), F.octet_length(html).cast("long").alias("length"), tag.alias("tag"), changed.alias("changed"), kind.alias("k"))
    pairs = lambda *kv: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in kv)), lambda e: e["value"].isNotNull()))
    response = F.struct(
        (F.col("page_id") * 4).alias("record_id"), F.col("url").alias("url"), F.col("start").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        pairs(("Content-Type", F.lit("text/html")), ("Content-Length", F.col("length")), ("ETag", F.col("tag")), ("Last-Modified", F.col("changed")), ("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.col("digest").alias("digest"), F.col("length").alias("length"),
    )
    sent_tag = F.when(F.col("k") == 3, F.lit('"other"')).when(F.col("k") == 4, F.concat(F.lit("W/"), F.col("tag"))).when(F.col("k") < 5, F.col("tag"))
    revisit = lambda n, url, ts: F.struct(
        (F.col("page_id") * 4 + n).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        pairs(("etag", sent_tag), ("last-modified", F.when(F.col("k") == 5, F.col("changed"))), ("Cache-Control", F.lit("max-age=600")), ("Date", F.concat(F.lit("d"), ts.cast("string"))), ("Server", F.lit("cache"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"),
    )
    later = revisit(1, F.concat(F.col("url"), F.lit("#seen")), F.col("start") + 86_400)
    sooner = F.when(F.col("page_id") % 5 == 0, revisit(2, F.col("url"), F.col("start") - 3_600))
    return base.select(F.explode(F.filter(F.array(response, later, sooner), lambda x: x.isNotNull())).alias("r")).select("r.*")


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages are read once; what goes on has headers and digests, no bodies
    records = cut(captures_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return resolve_revisits(records).withColumn("headers", header_text(F.col("headers")))


ORACLE = r"""
WITH base AS (
  SELECT page_id, url, (1700000000 + page_id * 7919 % 1000003)::BIGINT AS start, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS length, page_id % 7 AS k FROM pages),
tagged AS (SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag, 't' || start AS changed FROM base),
revisits AS (
  SELECT page_id * 4 + 1 AS record_id, url || '#seen' AS url, start + 86400 AS ts, * EXCLUDE (url) FROM tagged
  UNION ALL SELECT page_id * 4 + 2, url, start - 3600, * EXCLUDE (url) FROM tagged WHERE page_id % 5 = 0),
sent AS (SELECT record_id, url, ts, CASE WHEN k = 3 THEN '"other"' WHEN k = 4 THEN 'W/' || tag WHEN k < 5 THEN tag END AS etag, CASE WHEN k = 5 THEN changed END AS modified FROM revisits),
events AS (
  SELECT record_id, url, ts, etag, modified, true AS revisit, NULL AS digest, NULL AS length FROM sent
  UNION ALL SELECT page_id * 4, url, start, tag, changed, false, digest, length FROM tagged),
plain AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM events),
canon AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '') ||
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*(.*)$', 1), '([?&])(?:utm_[a-z]+)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS canonical FROM plain),
joined AS (
  SELECT *, last_value(CASE WHEN NOT revisit THEN {'id': record_id, 'ts': ts, 'etag': etag, 'modified': modified, 'digest': digest, 'length': length} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM canon),
judged AS (
  SELECT *, CASE WHEN hit IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(hit.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = hit.modified THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unvalidated' END AS verdict FROM joined WHERE revisit)
SELECT record_id, url, canonical, ts, verdict,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN hit.id END AS response_id,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN hit.ts END AS response_ts,
  CASE WHEN verdict IN ('resolved', 'unvalidated')
    THEN 'cache-control: max-age=600; content-length: ' || hit.length || '; content-type: text/html; date: d' || ts || '; etag: ' || coalesce(etag, hit.etag) || '; last-modified: ' || coalesce(modified, hit.modified)
    ELSE concat_ws('; ', 'cache-control: max-age=600', 'date: d' || ts, 'etag: ' || etag, 'last-modified: ' || modified, 'server: cache') END AS headers,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN hit.digest END AS digest,
  CASE WHEN verdict IN ('resolved', 'unvalidated') THEN hit.length END AS length
FROM judged
"""
