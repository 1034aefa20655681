"""Registered queries: revisit records and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import revisits, secret_scan
from .common import query, table

# Captures derived from a page: its response, its revisit a day later, and its host's robots.txt, which every
# fourth page finds anew and the others find unchanged. In Spark and DuckDB alike.
_CAPTURES = r"""
select page_id * 4 + k as record_id,
       case when k < 2 then url else concat(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1), '/robots.txt') end as url,
       1600000000 + case k when 0 then page_id * 7 when 1 then page_id * 7 + 86400 else page_id * 5 end as ts,
       case when k = 0 or k = 2 and page_id % 4 = 0 then 200 else 304 end as status,
       case when k = 0 then html when k = 2 and page_id % 4 = 0 then concat('User-agent: *', page_id) end as body,
       case when k = 1 and page_id % 5 = 1 then null when k = 1 and page_id % 5 = 0 then concat('b', page_id)
            when k = 2 then concat('r', cast(floor(page_id / 40) as bigint)) else concat('a', page_id) end as tag,
       case when k = 2 and page_id % 3 = 0 then null when k = 1 and page_id % 10 = 1 then 'Tue, 02 Jan 2024'
            else 'Mon, 01 Jan 2024' end as modified, k
from pages_k"""
_HEADERS = r"""
select record_id, url, ts, status, body, concat('HTTP/1.1 ', status, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
       'Date: ', ts, chr(13), chr(10), 'Content-Length: ', k, chr(13), chr(10), 'X-Cache: ', k, chr(13), chr(10),
       coalesce(concat('ETag: W/"', tag, '"', chr(13), chr(10)), ''), coalesce(concat('last-modified: ', modified, chr(13), chr(10)), ''))
       as http_headers
from captures"""

_ORACLE = rf"""
with pages_k as (select page_id, url, html, unnest([0, 1, 2]) as k from pages),
captures as ({_CAPTURES}),
x as (select *, regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1) as rest from captures),
y as (select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^(?:[^/?]*@)?([^/?]*)', 1)), ':(80|443)?$', ''), '^www\.', '') as host,
        regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '\.html$', ''), '/+$', '') as path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
          lambda p: p <> '' and not regexp_matches(p, '^({"|".join(revisits.TRACKING)})(=|$)'))), '&') as kept from x),
c as (select *, case when host <> '' then host || path || case when kept <> '' then '?' || kept else '' end end as uri from y),
r as (select *, last_value(case when status = 200 then record_id end ignore nulls) over (
        partition by uri order by ts, status, record_id rows between unbounded preceding and current row) as response_id from c),
m as (select r.*, f.tag as rtag, f.modified as rmod, f.k as rk, f.ts as rts, f.body as rbody from r left join captures f on f.record_id = r.response_id
      where r.status = 304),
o as (select *, case when response_id is null then 'no_response'
        when tag is not null and rtag is not null then case when tag = rtag then 'resolved' else 'validator_mismatch' end
        when modified is not null and rmod is not null then case when modified = rmod then 'resolved' else 'validator_mismatch' end
        else 'no_validator' end as outcome from m)
select record_id, response_id, outcome, case when outcome = 'resolved' then
         'content-length=' || rk || ';content-type=text/html;date=' || ts ||
         case when coalesce(tag, rtag) is not null then ';etag=W/"' || coalesce(tag, rtag) || '"' else '' end ||
         case when coalesce(modified, rmod) is not null then ';last-modified=' || coalesce(modified, rmod) else '' end ||
         ';x-cache=' || k end as headers,
       case when outcome = 'resolved' then md5(rbody) end as body_md5
from o"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture records derived from pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    rows = spark.sql("with captures as (" + _CAPTURES.replace("pages_k", "{pages_k}") + ")" + _HEADERS, pages_k=pages)
    return rows.withColumn("status", F.col("status").cast("int"))


@query("op1_revisits", _ORACLE)
def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(captures(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("record_id", "response_id", "outcome", F.when(F.col("headers").isNotNull(), F.concat_ws(";", pairs)).alias("headers"),
                      F.md5("body").alias("body_md5"))


@query("op10_secret_cnn")
def op10_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))
