"""Resolution of not-modified revisits in a web archive's records.

A revisit (a 304 answer) stands for the latest earlier full response of the
same canonical URL.  That response is found by an as-of window, the
validators of both are compared, and the response's headers are updated with
those of the revisit that a 304 may change.  Times of very frequent URLs are
cut into segments, and the last response of earlier segments is carried on,
so that no URL has to be in one task.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HEADERS = "array<struct<name:string,value:string>>"
# Fixed: headers that describe the connection or the body that was sent, which a 304 does not update.
KEPT = ["connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
        "transfer-encoding", "upgrade", "content-length", "content-encoding", "content-type", "content-range"]
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, www, standard port, closing slashes, fragment and tracking parameters.

    Parameters are sorted.  What is not an absolute URL stays as it is.
    """
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, SCHEME + r"([^/?#]*)", 1))
    for cut in ("^[^@]*@", r"^www\.", ":(80|443)$"):
        host = F.regexp_replace(host, cut, "")
    path = F.regexp_replace(F.regexp_extract(u, SCHEME + r"[^/?#]*([^?#]*)", 1), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(parts), "&"))).otherwise("")
    return F.when(u.rlike(SCHEME), F.concat(host, path, query)).otherwise(u)


def header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged(stored: Column, update: Column) -> Column:
    """The stored headers with those of the update that a 304 may change."""
    new = F.filter(update, lambda h: ~F.coalesce(F.lower(h["name"]).isin(KEPT), F.lit(True)))
    names = F.transform(new, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False))), new)


def strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def earlier(timeline: DataFrame, *keys: str) -> DataFrame:
    """Adds ``ref``: the last response strictly before each row."""
    order = W.partitionBy(*keys).orderBy("ts", "full", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return timeline.withColumn("ref", F.last("answer", ignorenulls=True).over(order))


def as_of(timeline: DataFrame, hot_rows: int) -> DataFrame:
    counts = timeline.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return earlier(timeline, "key")
    # Keys with more than hot_rows rows: at most rows / hot_rows of them.
    parts = min(10_000, ceil(most / hot_rows) + 1)
    hot = timeline.join(counts.select("key"), "key", "left_semi")
    cuts = hot.groupBy("key").agg(F.percentile_approx("ts", [i / parts for i in range(1, parts)]).alias("cuts"))
    cut = hot.join(cuts, "key").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("ts")))).drop("cuts")
    last = cut.groupBy("key", "part").agg(F.max_by("answer", F.struct("full", "ts", "id")).alias("answer"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("key", "part", F.last("answer", ignorenulls=True).over(before).alias("carried"))
    found = earlier(cut, "key", "part").join(carried, ["key", "part"]).withColumn("ref", F.coalesce("ref", "carried"))
    rest = earlier(timeline.join(counts.select("key"), "key", "left_anti"), "key")
    return rest.unionByName(found.select(*rest.columns))


def resolve(records: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """One row per revisit: id, key, verdict, response, payload_digest, headers.

    records: record_id, kind ('response' or 'revisit'), url, ts, headers,
    payload_digest; other kinds and columns are passed over.  The latest
    response of an earlier time counts (at one time the largest id).  Verdicts:
    ``etag`` (weak comparison), ``last_modified``, ``digest`` name the first
    validator that both have, if it agrees; ``mismatch`` if it does not;
    ``unchecked`` if there is none in common; ``no_earlier`` without earlier
    response, url or time.  Only agreeing revisits get response, digest and
    merged headers.  Repeated revisits have a row each.
    """
    heads = F.coalesce(F.col("headers").cast(HEADERS), F.array().cast(HEADERS))
    rows = (records.filter(F.col("kind").isin("response", "revisit"))
            .select(F.col("record_id").alias("id"), (F.col("kind") == "response").cast("int").alias("full"),
                    canonical_url(F.col("url")).alias("key"), "ts", heads.alias("headers"), F.col("payload_digest").alias("digest")))
    usable = F.col("key").isNotNull() & F.col("ts").isNotNull()
    answer = F.when(F.col("full") == 1, F.struct("id", "headers", "digest"))
    timeline = as_of(rows.filter(usable).withColumn("answer", answer), hot_rows)
    lost = rows.filter(~usable & (F.col("full") == 0)).withColumn("ref", F.lit(None).cast(timeline.schema["ref"].dataType))
    revisits = timeline.filter("full = 0").select(*lost.columns).unionByName(lost)

    def pair(name):
        return header(F.col("headers"), name), header(F.col("ref.headers"), name)
    (tag, old_tag), (date, old_date) = pair("etag"), pair("last-modified")
    old_digest = F.col("ref.digest")

    def says(new, old, name):
        return F.when(new == old, name).otherwise("mismatch")
    verdict = (F.when(F.col("ref").isNull(), "no_earlier")
               .when(tag.isNotNull() & old_tag.isNotNull(), says(strong(tag), strong(old_tag), "etag"))
               .when(date.isNotNull() & old_date.isNotNull(), says(date, old_date, "last_modified"))
               .when(F.col("digest").isNotNull() & old_digest.isNotNull(), says(F.col("digest"), old_digest, "digest"))
               .otherwise("unchecked"))
    out = revisits.withColumn("verdict", verdict)
    fits = F.col("verdict").isin("etag", "last_modified", "digest")
    return out.select("id", "key", "verdict", F.when(fits, F.col("ref.id")).alias("response"),
                      F.when(fits, old_digest).alias("payload_digest"),
                      F.when(fits, merged(F.col("ref.headers"), F.col("headers"))).alias("headers"))


def archive_of(pages: DataFrame) -> DataFrame:
    """Records derived from a page table: a full response and a revisit of each page.

    The times and validators follow from page_id, so that revisits agree by
    each validator, disagree, have none, or come before any response.
    """
    p, tag = F.col("page_id"), F.concat(F.lit('"'), F.col("md"), F.lit('"'))
    day = F.concat(F.lit("day "), (p % 97).cast("string"))
    none = F.lit(None).cast("string")

    def heads(*pairs):
        every = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs])
        return F.filter(every, lambda h: h["value"].isNotNull())
    response = F.struct(
        (p * 2).alias("record_id"), F.lit("response").alias("kind"), (p * 60).alias("ts"),
        heads(("Content-Type", F.lit("text/html")), ("Content-Length", F.col("size")), ("Server", F.concat(F.lit("s"), (p % 3).cast("string"))),
              ("Cache-Control", F.concat(F.lit("max-age="), (p % 100).cast("string"))), ("Date", p * 60),
              ("ETag", F.when(p % 7 == 6, none).when(p % 7 == 5, F.concat(F.lit("W/"), tag)).otherwise(tag)),
              ("Last-Modified", F.when(p % 5 == 4, none).otherwise(day))).alias("headers"),
        F.col("md").alias("payload_digest"))
    at = p * 60 + F.when(p % 3 == 0, 30).when(p % 3 == 1, -30).otherwise(100000)
    revisit = F.struct(
        (p * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), at.alias("ts"),
        heads(("Date", at), ("cache-control", F.lit("max-age=9")), ("Content-Length", F.lit("0")), ("Connection", F.lit("close")),
              ("Etag", F.when(p % 6 == 0, tag).when(p % 6 == 1, F.concat(F.lit("W/"), tag)).when(p % 6 == 2, F.lit('"other"'))),
              ("Last-Modified", F.when(p % 6 == 3, day).when(p % 6 == 4, F.lit("never")))).alias("headers"),
        F.when(p % 6 == 5, F.col("md")).alias("payload_digest"))
    rows = pages.select("page_id", "url", F.md5("html").alias("md"), F.octet_length("html").alias("size"))
    return rows.select("url", F.explode(F.array(response, revisit)).alias("r")).select("url", "r.*")


def header_lines(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(headers, lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))), "\n")
