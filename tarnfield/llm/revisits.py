"""Resolution of not-modified revisit records in web archives.

A revisit record says that a resource had not changed and carries no payload.
It is resolved by an as-of join: the latest strictly earlier full response of
the same canonical URL.  Their validators are compared, and the revisit's
headers are merged into the response's where the HTTP rules permit it.

The as-of join runs on (URL, slice).  Slices are ranges of the order by URL, time
and record that hold about equally many records, so a URL, or one instant of it,
with a great share of all records is spread over many groups whatever its times
are: each slice's last response is kept as one row, a running last over those
rows gives every slice its starting point, and inside a slice a running last
does the rest.  Payloads are not moved; a resolved record refers to the response
that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, read

#: Query parameters that do not change the resource.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: Headers that describe the stored payload or the connection: those of a 304 never replace them.
FIXED_HEADERS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
#: Records that one slice should not exceed by far.
ROWS_PER_SLICE = 200_000
LEAST_SLICES = 16


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without default port and user part, no fragment, no tracking parameters, the others sorted, no closing slash."""
    parts = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?", 0)
    piece = lambda i: F.regexp_extract(parts, "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?", i)
    scheme = F.lower(piece(1))
    port = F.when(scheme == "http", ":(80)?$").when(scheme == "https", ":(443)?$").otherwise(":$")
    host = F.regexp_replace(F.regexp_replace(F.lower(piece(2)), "^[^@]*@", ""), port, F.lit(""))
    path = F.regexp_replace(piece(3), "/+$", "")
    kept = F.filter(F.split(piece(4), "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    shape = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNull(), None).when(parts == "", F.trim(url)).otherwise(shape)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def validators_agree(revisit: Column, response: Column) -> Column:
    """First validator that both have decides: entity tag (weak comparison), last-modified, payload digest; none in common: no."""
    pair = lambda name, same: F.when(revisit[name].isNotNull() & response[name].isNotNull(), same)
    return F.coalesce(
        pair("etag", _weak(revisit["etag"]) == _weak(response["etag"])),
        pair("last_modified", revisit["last_modified"] == response["last_modified"]),
        pair("digest", revisit["digest"] == response["digest"]),
        F.lit(False),
    )


def merge_headers(stored: Column, update: Column) -> Column:
    """stored with the permitted headers of update added or put in place; names are compared in lower case.

    Of names that differ in case only, the one that sorts last counts (`date`, not `Date`).
    """

    def low(m: Column) -> Column:
        lines = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        names = lambda x: F.transform(x, lambda e: e["key"])
        last = lambda x: F.filter(x, lambda e, i: ~F.array_contains(names(F.slice(x, i + 2, F.size(x))), e["key"]))
        return F.map_from_entries(F.element_at(F.transform(F.array(lines), last), 1))

    new = F.map_filter(low(update), lambda k, v: ~k.isin(*FIXED_HEADERS))
    old = F.map_filter(low(stored), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def resolve(records: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row for each revisit of records(record_id, url, date, kind, etag, last_modified, digest, headers).

    kind is 'response' or 'revisit'; other kinds are ignored.  Result:
    record_id, canonical_url, response_id, status, digest, headers.  status is
    'resolved', 'validator_mismatch' or 'no_earlier_response' (also for
    revisits without a URL or date); only resolved rows carry digest and
    headers.  Responses of equal date are ordered by record_id; a response of
    the revisit's own instant is not earlier.  Repeated revisits each come out;
    null headers count as none; other columns of records are not looked at; an
    empty table gives an empty result.
    """
    base = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("date").cast("timestamp").alias("date"),
        (F.col("kind") == "response").alias("full"),
        *[F.col(c).cast("string").alias(c) for c in ("etag", "last_modified", "digest")],
        F.coalesce(F.col("headers"), F.expr("cast(map() as map<string, string>)")).alias("headers"),
        F.col("kind"),
    ).filter("kind in ('response', 'revisit')")
    usable = base.filter("canonical_url is not null and date is not null")
    slices = max(LEAST_SLICES, usable.count() // rows_per_slice)
    # a response is referred to by a struct that sorts by date and id
    answer = F.when(F.col("full"), F.struct("date", "record_id", "etag", "last_modified", "digest", "headers"))
    in_order = ["date", "full", "record_id"]
    ranges = usable.withColumn("answer", answer).repartitionByRange(slices, "canonical_url", *in_order)
    rows = durable(ranges.withColumn("slice", F.spark_partition_id()))

    order = F.struct("date", "record_id")
    last_of_slice = rows.filter("full").groupBy("canonical_url", "slice").agg(F.max_by("answer", order).alias("closing"))
    every_slice = rows.select("canonical_url", "slice").distinct().join(last_of_slice, ["canonical_url", "slice"], "left")
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = every_slice.select("canonical_url", "slice", F.last("closing", ignorenulls=True).over(before).alias("opening"))

    inside = Window.partitionBy("canonical_url", "slice").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(opening, ["canonical_url", "slice"])
    found = joined.withColumn("response", F.coalesce(F.last("answer", ignorenulls=True).over(inside), F.col("opening"))).filter("not full")

    names = ("record_id", "canonical_url", "etag", "last_modified", "digest", "headers")
    lost = base.filter("kind = 'revisit' and (canonical_url is null or date is null)").select(*names)
    lost = lost.withColumn("response", F.lit(None).cast(found.schema["response"].dataType))
    both = found.select(*names, "response").union(lost)
    agree = validators_agree(F.struct("etag", "last_modified", "digest"), F.col("response"))
    status = F.when(F.col("response").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id",
        "canonical_url",
        F.col("response.record_id").alias("response_id"),
        "status",
        F.when(ok, F.col("response.digest")).alias("digest"),
        F.when(ok, merge_headers(F.col("response.headers"), F.col("headers"))).alias("headers"),
    )


def with_payload(resolved: DataFrame, responses: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """resolved with the payload of the response that each row refers to."""
    payloads = responses.select(F.col(id_col).alias("response_id"), F.col(payload_col).alias("payload"))
    return resolved.join(payloads, "response_id", "left")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made from pages: each page is a full response, checked again once or twice under its URL.

    Times, validators and headers follow from page_id and html alone: every
    seventh page has another entity tag by the time of its checks, every fifth
    has only a modification date, and each check brings new cache headers and a
    wrong length that must not be taken over.  Pages without page_id are left
    out, since their records would have no id to be told apart by.
    """
    i = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tagged = i % 5 != 0
    stamp = lambda n: F.concat(F.lit("day-"), (n % 365).cast("string"))
    p = pages.filter("page_id is not null").select(
        i, "url", digest.alias("d"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size")
    )
    check = F.explode(F.sequence(F.lit(0), F.when(i % 3 == 0, 2).otherwise(1))).alias("check")
    p = p.select("*", check)
    again = F.col("check") > 0
    tag = F.concat(F.lit('"'), F.substring("d", 1, 16), F.when(again & (i % 7 == 0), "-new").otherwise(""), F.lit('"'))
    headers = F.when(
        again,
        F.create_map(
            F.lit("Cache-Control"), F.concat(F.lit("max-age="), (i % 100 * 60).cast("string")),
            F.lit("Content-Length"), F.lit("0"),
            F.lit("Date"), stamp(i + F.col("check")),
        ),
    ).otherwise(
        F.create_map(
            F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.col("size"),
            F.lit("date"), stamp(i),
            F.lit("server"), F.concat(F.lit("s"), (i % 9).cast("string")),
        )
    )
    return p.select(
        (i * 3 + F.col("check")).alias("record_id"),
        "url",
        F.timestamp_seconds(F.lit(1_600_000_000) + i * 60 + F.col("check") * F.when(i % 2 == 0, 30).otherwise(90_000)).alias("date"),
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(tagged, F.when(again, F.concat(F.lit("W/"), tag)).otherwise(tag)).alias("etag"),
        stamp(F.when(tagged, i + F.col("check")).otherwise(i)).alias("last_modified"),
        F.when(again, F.lit(None)).otherwise(F.col("d")).alias("digest"),
        headers.alias("headers"),
    )


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(records_of_pages(read(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return done.withColumn("headers", F.array_join(F.array_sort(lines), "\n"))


OP5_SQL = r"""
with own as (
  select page_id as i, url, md5(coalesce(html, '')) as d, cast(length(coalesce(html, '')) as varchar) as size
  from pages where page_id is not null),
expanded as (
  select *, unnest(range(0, case when i % 3 = 0 then 3 else 2 end)) as chk from own),
parts as (
  select *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?', ['s', 'h', 'p', 'q']) as u,
    regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)') as shaped
  from expanded),
canon as (
  select *, list_aggregate(list_sort(list_filter(string_split(u.q, '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))), 'string_agg', '&') as q2,
    regexp_replace(u.p, '/+$', '') as p2,
    regexp_replace(regexp_replace(lower(u.h), '^[^@]*@', ''), case lower(u.s) when 'http' then ':(80)?$' when 'https' then ':(443)?$' else ':$' end, '') as h2
  from parts),
records as (
  select i, chk, i * 3 + chk as record_id, d, size,
    case when url is null then null when not shaped then trim(url)
         else lower(u.s) || '://' || h2 || case when p2 = '' then '/' else p2 end || case when coalesce(q2, '') <> '' then '?' || q2 else '' end end as canonical_url,
    1600000000 + i * 60 + chk * case when i % 2 = 0 then 30 else 90000 end as t,
    case when i % 5 <> 0 then '"' || substr(d, 1, 16) || case when chk > 0 and i % 7 = 0 then '-new' else '' end || '"' end as etag,
    'day-' || cast(case when i % 5 <> 0 then (i + chk) % 365 else i % 365 end as varchar) as modified
  from canon),
joined as (
  select v.*, r.record_id as response_id, r.etag as r_etag, r.modified as r_modified, r.d as r_d, r.size as r_size, r.i as r_i,
    row_number() over (partition by v.record_id order by r.t desc nulls last, r.record_id desc nulls last) as rn
  from records v left join records r on r.chk = 0 and r.canonical_url = v.canonical_url and r.t < v.t
  where v.chk > 0),
judged as (
  select *, case when response_id is null then 'no_earlier_response'
    when (case when etag is not null and r_etag is not null then etag = r_etag else modified = r_modified end) then 'resolved'
    else 'validator_mismatch' end as status
  from joined where rn = 1)
select record_id, canonical_url, response_id, status,
  case when status = 'resolved' then r_d end as digest,
  case when status = 'resolved' then
    'cache-control: max-age=' || cast(i % 100 * 60 as varchar) || chr(10) || 'content-length: ' || r_size || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: day-' || cast((i + chk) % 365 as varchar) || chr(10) || 'server: s' || cast(r_i % 9 as varchar) end as headers
from judged
"""
