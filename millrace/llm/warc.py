"""Resolution of WARC not-modified revisits.

A revisit record says that a page had not changed; its payload is in an earlier record. It is resolved by an as-of
join: by canonical URL, to the latest full response before it. That response is the right one only if a validator
(entity tag, else date of last modification) agrees; its headers are then updated with those that a not-modified
response may change.

DataFrame functions only. One URL may hold a third of all records, so Spark range-partitions the records by URL and time, ties
by record, and each partition is a slot: within a slot and a URL, a running maximum finds the latest response; across slots one
row per URL and slot carries it on. The number of slots follows from the number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Headers that a 304 response updates; names are compared in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that only track; two patterns, a prefix and whole names.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
#: Records of a slot, at most, about.
SLOT_ROWS = 100_000


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, user, default port, leading www. and fragment; host in lower case, parameters
    sorted and without those that only track. Null stays null; what is no URL is only trimmed."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    bare = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(bare, parts, 1)), F.lower(F.regexp_extract(bare, parts, 2))
    path, query = F.regexp_extract(bare, parts, 3), F.regexp_extract(bare, parts, 4)
    host = F.regexp_replace(host, r"^.*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    params = F.array_sort(F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))
    return F.when(bare.rlike(parts), F.concat(host, path, query)).otherwise(bare)


def _strong(tag: Column) -> Column:
    """Weak comparison: the mark of weakness does not count."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the first stays. Null becomes empty."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    names = F.transform(entries, lambda e: e["k"])
    first = F.filter(entries, lambda e, i: F.array_position(names, e["k"]) == i + 1)
    made = F.map_from_arrays(F.transform(first, lambda e: e["k"]), F.transform(first, lambda e: e["v"]))
    return F.coalesce(made, F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """records: record_id, url, ts (ordered, e.g. long or timestamp), kind ('response' or 'revisit'), status (int), headers
    (map<string,string>). A full response has kind response and status 200.

    One row per revisit: record_id, canonical_url, ts, status_text (resolved, changed, no_validator or missing),
    response_id (of the latest full response strictly earlier; null if missing) and headers (merged if resolved, else the
    revisit's own; names in lower case). Of responses at one time the largest record_id counts. Records without url or
    ts meet nothing: such revisits are `missing`. Repeated revisits come out one for one. An entity tag on both sides
    decides alone; else both dates of last modification, else there is no validator. Further columns are left
    out, whatever their names. An empty input gives no rows.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").alias("ts"), "kind", "status", _lower_keys(F.col("headers")).alias("h"))
    r = cut(r.where("kind in ('response', 'revisit')"))
    known = r.where("canonical_url is not null and ts is not null")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    known = known.where(full | (F.col("kind") == "revisit")).withColumn("full", F.when(full, F.col("record_id")))
    # at one time revisits come before responses, which they do not meet; equal times are spread by record
    rank = [F.col("ts"), F.col("full").isNotNull(), F.coalesce("full", "record_id"), F.col("record_id")]
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-r.count() // slot_rows))
    known = cut(known.repartitionByRange(parts, "canonical_url", *rank).withColumn("slot", F.spark_partition_id()))
    place = F.struct("ts", "record_id", F.col("h").alias("headers"))
    # running latest response in the slot: a map cannot be compared, so its place is found first and then looked up
    before = Window.partitionBy("canonical_url", "slot").orderBy(*rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = known.withColumn("last", F.last(F.when(full, place), ignorenulls=True).over(before))
    sums = known.groupBy("canonical_url", "slot").agg(F.max_by(F.when(full, place), F.when(full, F.struct("ts", "record_id"))).alias("of_slot"))
    across = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # dealt out anew, so that the join sees two exchanges and can split the slots of a hot URL
    carried = cut(sums.withColumn("carried", F.last("of_slot", ignorenulls=True).over(across)).drop("of_slot"))
    revisits = seen.where("kind = 'revisit'").join(carried, ["canonical_url", "slot"], "left").withColumn("full_response", F.coalesce("last", "carried"))
    revisits = revisits.select("record_id", "canonical_url", "ts", "h", "full_response")
    lone = r.where("kind = 'revisit' and (canonical_url is null or ts is null)")
    out = revisits.unionByName(lone.select("record_id", "canonical_url", "ts", "h"), allowMissingColumns=True)

    then, now = F.col("full_response.headers"), F.col("h")
    tag_a, tag_b = _strong(then["etag"]), _strong(now["etag"])
    date_a, date_b = F.trim(then["last-modified"]), F.trim(now["last-modified"])
    same = F.when(tag_a.isNotNull() & tag_b.isNotNull(), tag_a == tag_b).when(date_a.isNotNull() & date_b.isNotNull(), date_a == date_b)
    status = F.when(F.col("full_response").isNull(), "missing").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("changed")
    allowed = F.map_filter(now, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(then, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    merged = F.when(status == "resolved", F.map_concat(kept, allowed)).otherwise(now)
    return out.select("record_id", "canonical_url", "ts", status.alias("status_text"), F.col("full_response.record_id").alias("response_id"), merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records for a table of pages: each page is a full response at twice its id, and is revisited an odd time
    later or, for some, earlier. The revisit names the page's own validator, unless its URL has none."""
    page = F.col("page_id")
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 8), 16, 10).cast("long")
    lag = (F.pmod(bucket, F.lit(1000)) - 200) * 2 + 1
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit(""))), 1, 16), F.lit('"'))
    tags = F.when(F.pmod(bucket, F.lit(10)) == 0, F.create_map().cast("map<string,string>"))
    length = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    response = pages.select(
        (page * 2).alias("record_id"), "url", (page * 2).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.map_concat(F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length, F.lit("Date"), (page * 2).cast("string")), F.coalesce(tags, F.create_map(F.lit("ETag"), tag))).alias("headers"))
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), "url", (page * 2 + lag).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_concat(F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), (page * 2 + lag).cast("string"), F.lit("Set-Cookie"), F.lit("s=1")), F.coalesce(tags, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag)))).alias("headers"))
    return response.unionByName(revisit)


def revisits_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, canonical_url, ts, status_text, response_id, header_lines (name: value, sorted, one a line)."""
    out = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    return out.select("record_id", "canonical_url", "ts", "status_text", "response_id", lines.alias("header_lines"))


def oracle_sql() -> str:
    """The same rows in DuckDB, as a join on the URL and an aggregate."""
    permitted = "'content-length: ' || length_1, 'content-type: text/html', 'date: ' || ts"
    return rf"""
WITH u AS (
  SELECT page_id, url, coalesce(html, '') AS html, trim(url) AS bare,
         ('0x' || substr(md5(coalesce(url, '')), 1, 8))::BIGINT AS bucket,
         regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', ['scheme', 'host', 'path', 'query', 'fragment']) AS x
  FROM pages),
h AS (
  SELECT *, regexp_replace(lower(x.host), '^.*@', '') AS host0,
         list_sort(list_filter(string_split(substr(x.query, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS params
  FROM u),
c AS (
  SELECT page_id, bucket, html,
         '"' || substr(md5(html), 1, 16) || '"' AS tag, bucket % 10 <> 0 AS has_tag, CAST(octet_length(encode(html)) AS VARCHAR) AS n,
         page_id * 2 AS ts_1, page_id * 2 + (bucket % 1000 - 200) * 2 + 1 AS ts_2,
         CASE WHEN x.scheme = '' THEN bare ELSE
           regexp_replace(CASE lower(x.scheme) WHEN 'http' THEN regexp_replace(host0, ':80$', '') WHEN 'https' THEN regexp_replace(host0, ':443$', '') ELSE host0 END, '^www\.', '')
           || CASE WHEN x.path = '' THEN '/' ELSE x.path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical_url
  FROM h),
j AS (
  SELECT b.page_id * 2 + 1 AS record_id, b.canonical_url, b.ts_2 AS ts, b.tag, b.has_tag,
         max(a.ts_1) AS response_id, arg_max(a.tag, a.ts_1) AS tag_1, arg_max(a.has_tag, a.ts_1) AS has_1, arg_max(a.n, a.ts_1) AS length_1
  FROM c b LEFT JOIN c a ON a.canonical_url = b.canonical_url AND a.ts_1 < b.ts_2 GROUP BY ALL),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN NOT (has_tag AND has_1) THEN 'no_validator' WHEN tag = tag_1 THEN 'resolved' ELSE 'changed' END AS status_text
  FROM j)
SELECT record_id, canonical_url, ts, status_text, response_id,
       array_to_string(CASE WHEN status_text = 'resolved' THEN [{permitted}, 'etag: W/' || tag]
         ELSE list_filter(['content-length: 0', 'date: ' || ts, CASE WHEN has_tag THEN 'etag: W/' || tag END, 'set-cookie: s=1'], lambda e: e IS NOT NULL) END, chr(10)) AS header_lines
FROM s"""
