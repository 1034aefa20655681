"""Not-modified revisit records resolved to the full response that they repeat.

A crawl's capture records are full responses (200 with a body) and revisits (304:
the server said that the page had not changed). A revisit takes the latest earlier
full response of its canonical URL, if the validators allow it: both have an ETag
and these agree in the weak comparison, or, where one has no ETag, both have the
same Last-Modified. Its headers are the response's, updated by the revisit's as
HTTP caches do: by all but those that describe the body or the connection.

The as-of join works on slim rows (no body, no headers). They are range-partitioned
by (URL, time, rank, id), so the captures of one URL may span many partitions and
a URL with a third of all rows is no hot key. Windows run within a partition's
part of a URL; the last response of each part is carried to the URL's later parts
through a table with one row per part, and one window over a URL's parts, of which
there are at most as many as partitions. Bodies are joined to the resolved rows only
at the end, by record and a part of its revisits: a response that a third of all rows
repeat is copied to as many tasks as there are parts, and never more often than it
is reported. Revisits without a response pass no join.

Defined cases: records without URL, time or id never match and are reported as
`no_response`, each as it comes; a null status counts as neither kind; at equal times
responses come before revisits ("earlier" includes the same second) and then the larger
id is the later. A record is its id, URL, time, status and header block: repeated ones
are one record, and of responses that differ in nothing but the body the smallest body
counts. Records that share an id but differ otherwise are records of their own, and
body and headers of a result come from one of them. Extra columns are not read. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

# Headers of a 304 that do not update a stored response.
KEPT_OF_RESPONSE = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
                    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def canonical_url(url: Column) -> Column:
    """Lower-case host without user, default port and www, no scheme, fragment or tracking parameters; sorted query.

    A path's last slash and ``.html`` go. Null for null and for what has no host.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^(?:[^/?]*@)?([^/?]*)", 1)), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1), r"\.html$", ""), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    names = "^(" + "|".join(TRACKING) + ")(=|$)"
    kept = F.concat_ws("&", F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(names))))
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def header_pairs(block: Column) -> Column:
    """An HTTP header block as an array of (k, v) with lower-case names."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[A-Za-z0-9-]+:"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"),
                                                 F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v")))


def header_map(pairs: Column) -> Column:
    """(k, v) pairs as a map; of repeated names the last stays."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.aggregate(pairs, empty, lambda m, p: F.map_concat(
        F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"]))), empty)


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers updated by a revisit's permitted ones."""
    permitted = F.map_filter(revisit, lambda k, v: ~k.isin(*KEPT_OF_RESPONSE))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def latest_response(records: DataFrame) -> DataFrame:
    """Slim revisit rows with `response_id`, the latest earlier full response of their URL, and its validators.

    `records`: record_id, copy (tells records of one id apart), uri, ts, status, etag, last_modified.
    """
    slim = records.select("record_id", "copy", "uri", "ts", "etag", "last_modified", (F.col("status") == 304).alias("revisit")).where(
        F.col("status").isin(200, 304) & F.col("uri").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull())
    order = ["uri", "ts", "revisit", "record_id", "copy"]
    cut = materialise(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "captures")
    found = F.when(~F.col("revisit"), F.struct("record_id", "copy", "etag", "last_modified"))
    here = W.partitionBy("part", "uri").orderBy("ts", "revisit", "record_id", "copy").rowsBetween(W.unboundedPreceding, 0)
    rows = cut.withColumn("own", F.last(found, ignorenulls=True).over(here))
    # The last response of each part of a URL, carried to its later parts.
    parts = cut.groupBy("uri", "part").agg(F.max(F.when(~F.col("revisit"), F.struct("ts", "record_id", "copy", "etag", "last_modified"))).alias("best"))
    before = W.partitionBy("uri").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.withColumn("carried", F.last("best", ignorenulls=True).over(before)).where("carried is not null")
    carried = carried.select("uri", "part", F.struct("carried.record_id", "carried.copy", "carried.etag", "carried.last_modified").alias("carried"))
    out = rows.where("revisit").join(carried, ["uri", "part"], "left").withColumn("of", F.coalesce("own", "carried"))
    return out.select("record_id", "copy", "etag", "last_modified", F.col("of.record_id").alias("response_id"), F.col("of.copy").alias("response_copy"),
                      F.col("of.etag").alias("response_etag"), F.col("of.last_modified").alias("response_modified"))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, response_id, outcome, merged headers and body of the response.

    `records`: record_id long, url string, ts (comparable), status int, http_headers string, body string.
    Outcomes: resolved, validator_mismatch, no_validator, no_response.
    """
    spark = records.sparkSession
    copy = F.xxhash64("url", "ts", "status", "http_headers").alias("copy")
    # The explode of one element keeps the block from being parsed once per use.
    parsed = records.select("record_id", copy, "ts", "status", F.explode(F.array(header_pairs(F.col("http_headers")))).alias("pairs"),
                            canonical_url(F.col("url")).alias("uri"))
    parsed = materialise(parsed.withColumn("headers", header_map(F.col("pairs"))).drop("pairs"), "capture-headers")
    slim = parsed.withColumns({"etag": F.col("headers")["etag"], "last_modified": F.col("headers")["last-modified"]})
    matched = latest_response(slim.select("record_id", "copy", "uri", "ts", "status", "etag", "last_modified"))
    same_tag = _strong(F.col("etag")) == _strong(F.col("response_etag"))
    outcome = (F.when(F.col("response_id").isNull(), "no_response")
               .when(F.col("etag").isNotNull() & F.col("response_etag").isNotNull(), F.when(same_tag, "resolved").otherwise("validator_mismatch"))
               .when(F.col("last_modified").isNotNull() & F.col("response_modified").isNotNull(),
                     F.when(F.col("last_modified") == F.col("response_modified"), "resolved").otherwise("validator_mismatch"))
               .otherwise("no_validator"))
    matched = matched.select("record_id", "copy", "response_id", "response_copy", outcome.alias("outcome")).distinct()
    revisits = parsed.where("status = 304")
    able = F.col("uri").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    own = revisits.where(able).select("record_id", "copy", F.col("headers").alias("own"))
    told = own.dropDuplicates(["record_id", "copy"]).join(matched, ["record_id", "copy"])
    told = materialise(told, "revisit-outcomes")

    # A response meets its revisits in parts, at least as many as the shuffles have tasks.
    n_parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    resolved = told.where("outcome = 'resolved'").withColumn("part", F.pmod(F.xxhash64("record_id", "copy"), F.lit(n_parts)))
    wanted = resolved.select("response_id", "response_copy", "part").distinct()
    full = records.where("status = 200 and record_id is not null").select(
        F.col("record_id").alias("response_id"), copy.alias("response_copy"), F.struct("body", "http_headers").alias("full"))
    full = full.groupBy("response_id", "response_copy").agg(F.min("full").alias("full")).join(wanted, ["response_id", "response_copy"])
    resolved = resolved.join(full, ["response_id", "response_copy", "part"])
    pairs = F.explode(F.array(header_pairs(F.col("full.http_headers")))).alias("pairs")
    resolved = resolved.select("record_id", "response_id", "outcome", "own", F.col("full.body").alias("body"), pairs).select(
        "record_id", "response_id", "outcome", merged_headers(header_map(F.col("pairs")), F.col("own")).alias("headers"), "body")

    def bare(rows: DataFrame, response, outcome) -> DataFrame:
        return rows.select("record_id", response.cast("long").alias("response_id"), outcome.alias("outcome"),
                           F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("body"))

    return (resolved.unionByName(bare(told.where("outcome <> 'resolved'"), F.col("response_id"), F.col("outcome")))
            .unionByName(bare(revisits.where(~able), F.lit(None), F.lit("no_response"))))
