"""WARC records, and revisit records ("304 Not Modified") resolved to full responses.

A revisit says that a page hadn't changed since an earlier capture; its content is
that of the latest earlier full response for the same canonical URL. That is an
as-of join. It is done on narrow rows: captures of a URL are put into ``SLICES``
time slices that hold about as many captures each; within a slice a window finds the response before each revisit, and
for revisits before the first response of their slice the last response of an
earlier slice is carried on from one row a slice. So a URL with very many captures is
dealt over many tasks, and bodies move only once, to the revisits that resolve.

The validators are then checked: the revisit's ETag must weakly match the
response's; without one, its Last-Modified must be equal. A 304 may renew some headers of the stored response
(``RENEWED``); the merged headers are the response's with these replaced.

Status of a revisit: ``resolved``; ``changed`` where the latest earlier
response has another validator; ``unchecked`` where the revisit has no
validator that the response has too (it is resolved, as no check speaks against it);
``orphan`` where no earlier response exists.

Defined results: a revisit without URL or time matches nothing (orphan), a response
without them is never found. Of responses with equal time the one with the greatest id counts
as latest; a response at the revisit's own time isn't earlier. Repeated revisits each give
their row; of responses that share record id and time the one counts whose body sorts first (by hash), and
one without an id can't be referred to.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Header fields that a 304 response may carry for the stored response (lower case).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't choose content.
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Scheme and fragment dropped, host lower-cased without ``www.``/``m.`` and default port, tracking parameters and a trailing slash dropped, other parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    path = F.when(path == "/", "").otherwise(F.regexp_replace(path, "/$", ""))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _bare_etag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit of ``records``: record_id, url_key, captured_at, status, source_id, headers, body.

    ``records``: record_id string, kind string ('response' or 'revisit'),
    url string, captured_at timestamp, headers map<string,string>, body string.
    """
    own = F.when(F.col("kind") == "revisit", F.col("headers")).alias("own")
    all_ = written(records.select("record_id", "kind", "captured_at", canonical_url(F.col("url")).alias("url_key"), own), "captures")
    known = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()
    named = all_.where(known).withColumn("at", F.unix_micros("captured_at"))
    cuts = named.agg(F.percentile_approx("at", [(i + 1) / slices for i in range(slices - 1)], 10_000).alias("c")).first()["c"] if slices > 1 else []  # one row
    rows = named.withColumn("slice", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [])))).cast("array<bigint>"), lambda c: c < F.col("at"))))
    response = F.when((F.col("kind") == "response") & F.col("record_id").isNotNull(), F.struct("at", F.col("record_id").alias("id")))

    within = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(response).over(within)).where("kind = 'revisit'")
    last = rows.where("kind = 'response'").groupBy("url_key", "slice").agg(F.max(response).alias("last"))
    wanted = near.where("near is null").select("url_key", "slice").distinct()
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = last.join(wanted.withColumn("asked", F.lit(True)), ["url_key", "slice"], "full").withColumn("carried", F.max("last").over(earlier)).where("asked").select("url_key", "slice", "carried")
    source = F.coalesce("near", "carried")
    found = near.join(ends, ["url_key", "slice"], "left").select("record_id", "url_key", "captured_at", "own", source["id"].alias("source_id"), source["at"].alias("source_at"))
    alone = all_.where(~known & (F.col("kind") == "revisit")).select("record_id", "url_key", "captured_at", "own", F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("bigint").alias("source_at"))
    found = written(found.unionByName(alone), "found")

    # only responses that are referred to move with their bodies
    asked = found.select("source_id", "source_at").where("source_id is not null").distinct()
    full = records.where("kind = 'response'").select(F.col("record_id").alias("source_id"), F.unix_micros("captured_at").alias("source_at"), F.struct(F.col("headers").alias("stored"), "body").alias("r"))
    full = full.join(asked, ["source_id", "source_at"], "left_semi")
    one = full.groupBy("source_id", "source_at").agg(F.min_by("r", F.xxhash64("r.body")).alias("r")).select("source_id", "source_at", "r.*")
    joined = found.join(one, ["source_id", "source_at"], "left")
    own_tag, tag = _bare_etag(F.col("own")["etag"]), _bare_etag(F.col("stored")["etag"])
    own_time, time = F.col("own")["last-modified"], F.col("stored")["last-modified"]
    status = (
        F.when(F.col("source_id").isNull(), "orphan")
        .when(own_tag.isNotNull() & tag.isNotNull(), F.when(own_tag == tag, "resolved").otherwise("changed"))
        .when(own_time.isNotNull() & time.isNotNull(), F.when(own_time == time, "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    takes = F.col("status").isin("resolved", "unchecked")
    renewed = F.map_filter("own", lambda k, v: k.isin(*RENEWED))
    kept = F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    merged = F.map_from_entries(F.array_sort(F.concat(F.map_entries(kept), F.map_entries(renewed))))
    return joined.withColumn("status", status).select(
        "record_id", "url_key", "captured_at", "status", F.when(takes, F.col("source_id")).alias("source_id"), F.when(takes, merged).alias("headers"), F.when(takes, F.col("body")).alias("body")
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log of all pages: for each page a full response, and a revisit some hours later.

    Made from page_id, url and html alone. A revisit carries the page's ETag,
    for some pages, by their id, an outdated one, or only a date.
    """
    begin = F.lit(1_700_000_000) + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    modified = (begin - 3600).cast("string")
    case = F.pmod("page_id", F.lit(5))
    response = F.struct(
        F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", F.timestamp_seconds(begin).alias("captured_at"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), begin.cast("string"), F.lit("etag"), etag, F.lit("last-modified"), modified).alias("headers"), F.col("html").alias("body"),
    )
    again = begin + 7200
    dated = F.create_map(F.lit("date"), again.cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"))
    with_tag = F.map_concat(dated, F.create_map(F.lit("etag"), F.when(case == 0, F.lit('"outdated"')).otherwise(F.concat(F.lit("W/"), etag))))
    revisit = F.struct(
        F.concat(F.lit("v"), F.col("page_id")).alias("record_id"), F.lit("revisit").alias("kind"), "url", F.timestamp_seconds(again).alias("captured_at"),
        F.when(case == 1, dated).when(case == 2, F.map_concat(dated, F.create_map(F.lit("last-modified"), modified))).otherwise(with_tag).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes (plain or gzip): headers of the record, of the HTTP message, and the body."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)  # inflates member by member, as it is read
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        record = _fields(stream)
        block = stream.read(int(record.get("content-length", "0")))
        head, body = {}, block
        if record.get("content-type", "").startswith("application/http"):
            first, _, rest = block.partition(b"\r\n")
            message = io.BytesIO(rest)
            head = _fields(message) | {":status": first.decode("latin-1").split(" ")[1] if b" " in first else ""}
            body = message.read()
        yield {"record": record, "http": head, "body": body}


def _fields(stream: io.BytesIO) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()) and line.strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of WARC files as ``resolve_revisits`` takes them. Bodies are the bytes that were sent. A file is read by one task, a record at a time."""
    schema = "record_id string, kind string, url string, captured_at timestamp, headers map<string,string>, body binary"

    def rows(it):
        import pandas as pd

        for pdf in it:
            for content in pdf["content"]:
                found = [r for r in parse_records(content) if r["record"].get("warc-type") in ("response", "revisit")]
                yield pd.DataFrame(
                    [
                        (r["record"].get("warc-record-id"), r["record"]["warc-type"], r["record"].get("warc-target-uri"), pd.to_datetime(r["record"].get("warc-date"), utc=True, errors="coerce"), r["http"], r["body"])
                        for r in found
                    ],
                    columns=["record_id", "kind", "url", "captured_at", "headers", "body"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)
