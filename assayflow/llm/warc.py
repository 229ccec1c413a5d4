"""WARC revisits: as-of join by canonical URL to the latest earlier full response, validators, permitted headers."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Slices of time, of about equally many records each wherever in time they lie. One URL's records are joined a slice
#: at a time, so a busy URL spreads over that many tasks.
SLICES = 1024
#: What a not-modified answer may not change: they describe the body, which is the earlier response's.
FIXED_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")

RECORD = "record_id long, url string, captured long, type string, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port, fragment, utm_ parameters and a final slash go; the host is lower-cased."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.regexp_replace(u, "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www[.]|:(?:80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(u, "^[^/?]*(.*)$", 1), "([?&])utm_[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def validators_agree(etag: Column, modified: Column, digest: Column, then_etag: Column, then_modified: Column, then_digest: Column) -> Column:
    """ETags decide if both records have one (weak comparison), then Last-Modified, then payload digests; else no."""
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    return F.coalesce(weak(etag) == weak(then_etag), modified == then_modified, digest == then_digest, F.lit(False))


def merged_headers(base: Column, over: Column) -> Column:
    """The earlier response's headers, updated by the revisit's permitted ones. Names are lower-cased beforehand."""
    empty = F.create_map().cast("map<string,string>")
    over = F.map_filter(F.coalesce(over, empty), lambda k, _: ~k.isin(*FIXED_HEADERS))
    return F.map_concat(F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row per record (columns of RECORD): record_id, url_key, captured, type, status, refers_to, digest, headers.

    status: response, resolved, no_earlier_response, validator_mismatch, or other for types that are neither response
    nor revisit. A revisit refers to the latest response with its canonical URL captured strictly earlier, the largest
    record_id among equals; resolved ones have that response's digest and the merged headers. Unresolved ones keep
    their own. Null URLs are the empty URL; a record without a time is never earlier and has nothing earlier; null
    validators decide nothing; repeated records stay rows. Empty tables give no rows; other columns are ignored.
    """
    names = ["record_id", "captured", "type", "etag", "last_modified", "digest", "headers"]
    rows = materialize(records.select(canonical_url(F.col("url")).alias("url_key"), *names), "warc-records")
    edges = rows.filter("captured is not null").approxQuantile("captured", [i / SLICES for i in range(1, SLICES)], 0.25 / SLICES)
    deal = Bucketizer(splits=[float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")], inputCol="at", outputCol="slice")
    rows = deal.transform(rows.withColumn("at", F.coalesce("captured", F.lit(0)).cast("double"))).withColumn("slice", F.col("slice").cast("int")).drop("at")
    full = F.when((F.col("type") == "response") & F.col("captured").isNotNull(), F.struct("captured", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers")))

    # the latest response of each URL and slice, carried to the next slices in which the URL has records
    ends = rows.filter("captured is not null").groupBy("url_key", "slice").agg(F.max(full).alias("then"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "slice", F.max("then").over(before).alias("then")).filter("then is not null")

    own = rows.select("url_key", "slice", *names, full.alias("own"), F.lit(True).alias("real"))
    brought = carried.select("url_key", "slice", F.col("then.captured").alias("captured"), F.col("then").alias("own"), F.lit(False).alias("real"))
    earlier = Window.partitionBy("url_key", "slice").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    found = own.unionByName(brought, allowMissingColumns=True).withColumn("then", F.when(F.col("captured").isNotNull(), F.max("own").over(earlier))).filter("real")

    agree = validators_agree(F.col("etag"), F.col("last_modified"), F.col("digest"), F.col("then.etag"), F.col("then.last_modified"), F.col("then.digest"))
    status = (
        F.when(F.col("type") == "response", "response").when(F.coalesce(F.col("type") != "revisit", F.lit(True)), "other")
        .when(F.col("then").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    )
    found = found.withColumn("status", status).withColumn("done", F.col("status") == "resolved")
    return found.select(
        "record_id", "url_key", "captured", "type", "status",
        F.when(F.col("status").isin("resolved", "validator_mismatch"), F.col("then.record_id")).alias("refers_to"),
        F.when(F.col("done"), F.col("then.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("done"), merged_headers(F.map_from_entries("then.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds body to resolve_revisits' rows from bodies (record_id, body): each record's own, or the one it refers to.

    A body column that the rows have already is replaced.
    """
    source = F.when(F.col("status") == "resolved", F.col("refers_to")).otherwise(F.col("record_id"))
    held = bodies.select(F.col("record_id").alias("body_of"), F.col("body").alias("held_body"))
    joined = resolved.select(F.struct(*resolved.columns).alias("row"), source.alias("source")).join(held, F.col("source") == F.col("body_of"), "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in resolved.columns if c != "body"], F.col("held_body").alias("body"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of the pages table (page_id, url, html), with columns of RECORD.

    Each page is a full response at time page_id div 3. Each is asked for again 1 to 5 ticks later under another
    spelling of its URL and found not modified; every eleventh of these has an ETag that no longer fits, every seventh
    no ETag but a payload digest, every thirteenth no validator.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("string").alias("size"), F.expr("page_id div 3").alias("at"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    headers = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k.replace("_", "-")), v)])
    none = F.lit(None).cast("string")
    response = base.select(
        (2 * F.col("page_id")).alias("record_id"), "url", F.col("at").alias("captured"), F.lit("response").alias("type"), tag.alias("etag"), none.alias("last_modified"), "digest",
        headers(content_type=F.lit("text/html"), content_length=F.col("size"), etag=tag, date=F.col("at").cast("string")).alias("headers"),
    )
    later = F.col("at") + 1 + F.pmod("page_id", F.lit(5))
    gone = F.pmod("page_id", F.lit(13)) == 0
    asked = F.when(gone, none).when(F.pmod("page_id", F.lit(11)) == 0, F.lit('"stale"')).when(F.pmod("page_id", F.lit(7)) == 0, none).otherwise(F.concat(F.lit("W/"), tag))
    again = base.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("captured"), F.lit("revisit").alias("type"), asked.alias("etag"),
        none.alias("last_modified"), F.when(gone, none).otherwise(F.col("digest")).alias("digest"),
        headers(content_length=F.lit("0"), date=later.cast("string"), x_cache=F.lit("hit")).alias("headers"),
    )
    return response.unionByName(again)
