"""Operator 6: resolving not-modified revisits of web archives.

A revisit record says that a page had not changed and holds no payload.  Each is
joined, as of its time, to the latest earlier full response of the same canonical
URL; the validators (ETag, else Last-Modified) must agree; and the headers that a
304 answer may update replace the response's.

The as-of join sorts all records by (URL, time) into ranges of about equal rows, so
the captures of one very common URL spread over many tasks.  Inside a range a
window carries the last response forward; what a range inherits is the last
response of the ranges before it, one row per range.  Payloads take no part: the
result names the response, and ``attach_payload`` joins it by id.

Defined results: a record without URL resolves to nothing (``no_response``), as
does one without time; responses at the revisit's own time are not earlier; of
responses at one time the largest id counts as the latest; header names are
compared without case, the last of repeated names counts; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Headers of a 304 answer that leave the stored ones alone: they describe the
# connection or the (absent) body (RFC 9111, 3.2).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "utm_[a-z]+|ref"          # query parameters that do not change the page


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a last
    slash go; the host is lower-cased and parameters are sorted.  Null without ``://``."""
    host = F.lower(F.regexp_extract(url, r"(?s)^[^/?#]*?://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^/?#]*?://[^/?#]*([^?#]*)", 1), r"/$", "")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)")))
    tail = F.array_join(kept, "&")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def plain_headers(headers: Column) -> Column:
    """Lower-cased names, the last value of each."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(low, lambda e, i: ~F.exists(
        F.slice(low, i + 2, F.greatest(F.size(low), F.lit(1))), lambda later: later["key"] == e["key"])))


def merge_headers(stored: Column, update: Column) -> Column:
    new = F.map_filter(update, lambda k, v: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame, *, id_col: str = "record_id", url_col: str = "uri", time_col: str = "warc_date",
                     type_col: str = "warc_type", headers_col: str = "headers", parts: int | None = None,
                     scratch: Scratch | None = None) -> DataFrame:
    """Per revisit: (id, canonical_url, status, response_id, headers).

    ``status``: resolved, etag_mismatch, date_mismatch, no_validator, no_response;
    ``headers`` are merged only for a resolved one, else the revisit's own."""
    scratch = scratch or Scratch(records.sparkSession, "revisits")
    d = records.where(F.col(type_col).isin("response", "revisit")).select(
        F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("u"), F.col(time_col).alias("t"),
        (F.col(type_col) == "response").alias("full"), plain_headers(F.col(headers_col)).alias("h"))
    usable = F.col("u").isNotNull() & F.col("t").isNotNull()
    keys = ["u", "t", "full", "id"]
    n = parts or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.keep(d.where(usable).repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()), "ranges")
    response = F.when(F.col("full"), F.struct("u", "id", "h"))
    before = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.where("full").groupBy("range").agg(F.max_by(F.struct("u", "id", "h"), F.struct("u", "t", "id")).alias("end"))
    ranges = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).join(ends, "range", "left")       # a row per range
    handed = ranges.select("range", F.last("end", ignorenulls=True).over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("handed"))
    seen = ranged.withColumn("near", F.last(response, ignorenulls=True).over(before)).where("NOT full").join(handed, "range")
    last = F.when(F.col("near.u") == F.col("u"), F.col("near")).when(F.col("handed.u") == F.col("u"), F.col("handed"))
    seen = seen.select("id", "u", "h", last.alias("r"))
    lost = d.where(~usable & ~F.col("full"))
    lost = lost.select("id", "u", "h", F.lit(None).cast(seen.schema["r"].dataType).alias("r"))
    r = seen.unionByName(lost)

    def tag(h: str) -> Column:
        return F.regexp_replace(F.try_element_at(F.col(h), F.lit("etag")), "^W/", "")

    def date(h: str) -> Column:
        return F.try_element_at(F.col(h), F.lit("last-modified"))

    status = F.when(F.col("r").isNull(), "no_response") \
        .when(tag("h").isNotNull(), F.when(tag("h").eqNullSafe(tag("r.h")), "resolved").otherwise("etag_mismatch")) \
        .when(date("h").isNotNull(), F.when(date("h").eqNullSafe(date("r.h")), "resolved").otherwise("date_mismatch")) \
        .otherwise("no_validator")
    r = r.withColumn("status", status)
    return r.select(F.col("id").alias(id_col), F.col("u").alias("canonical_url"), "status", F.col("r.id").alias("response_id"),
                    F.when(F.col("status") == "resolved", merge_headers(F.col("r.h"), F.col("h"))).otherwise(F.col("h")).alias("headers"))


def attach_payload(resolved: DataFrame, records: DataFrame, *, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """The payload of the response that a revisit resolved to."""
    p = records.select(F.col(id_col).alias("_pid"), F.col(payload_col).alias("payload"))
    return resolved.join(p, (F.col("status") == "resolved") & (F.col("response_id") == F.col("_pid")), "left").drop("_pid")


def captures(pages: DataFrame) -> DataFrame:
    """WARC records made of ``pages`` (page_id, url, html), four for every page:

    0 a full response, at a time that follows the id; 1 a revisit a day later, by
    another form of the URL, whose ETag agrees; 2 a revisit two days later, every
    third by Last-Modified, others with another ETag; 3 a revisit an hour before
    the response, whose tag is that of this page."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.pmod("page_id", F.lit(28)) + 1
    modified = F.concat(F.lpad(day.cast("string"), 2, "0"), F.lit(" Jan 2024 00:00:00 GMT"))
    time = F.col("page_id") * 60
    third = F.pmod("page_id", F.lit(3)) == 0

    def record(k: int, kind: str, t: Column, uri: Column, *headers: Column) -> Column:
        return F.struct((F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("warc_type"), t.cast("long").alias("warc_date"),
                        uri.alias("uri"), F.create_map(*headers).alias("headers"))

    rows = F.array(
        record(0, "response", time, F.col("url"), F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"),
               F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")),
        record(1, "revisit", time + 86_400, F.concat("url", F.lit("#again")), F.lit("etag"), F.concat(F.lit("W/"), tag),
               F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("x-revisit"), F.lit("1")),
        record(2, "revisit", time + 172_800, F.col("url"), F.when(third, F.lit("Last-Modified")).otherwise(F.lit("ETag")),
               F.when(third, modified).otherwise(F.lit('"other"')), F.lit("Date"), F.lit("later")),
        record(3, "revisit", time - 3_600, F.col("url"), F.lit("ETag"), tag))
    return pages.select(F.explode(rows).alias("r")).select("r.*")
