"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response, with validators and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may carry for the stored response (HTTP semantics, section on status 304).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|sid)(=|$)"
#: Seconds of captures that one task sorts for one URL.
SLICE_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Scheme-less form: lower-case host without www., user and default port; no fragment, tracking parameters or
    trailing slash; parameters sorted. Null stays null; text that is no URL is kept but for these rules."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    address, query = F.split_part(rest, F.lit("?"), F.lit(1)), F.regexp_replace(rest, "^[^?]*[?]?", "")
    host = F.lower(F.split_part(address, F.lit("/"), F.lit(1)))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_replace(address, "^[^/]*", ""), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _bare(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row for each revisit record: record_id, canonical_url, refers_to, outcome and merged headers.

    `records`: record_id bigint, type ('response' or 'revisit'), url, captured_at bigint (seconds), status int, headers
    map<string,string> with lower-case names, digest string. A full response has status 200. A revisit is held against the latest
    response of its canonical URL with an earlier time, or the same time and a smaller id. Validators, the first that both
    sides have decides: etag (weak comparison), last-modified, digest. Outcomes: resolved, mismatch, unvalidated (no common
    validator) and missing (no earlier response; also for a null URL or time). Only resolved rows have headers: the
    response's, replaced by the PERMITTED ones of the revisit. Other columns and types are ignored; equal records repeat.

    The latest response is found within (URL, time slice) first and carried from earlier slices by one row a slice, so
    a URL with a third of all captures is spread over tasks.
    """
    r = records.select(
        "record_id", (F.col("type") == "revisit").alias("is_revisit"), canonical_url(F.col("url")).alias("canonical_url"), F.col("captured_at").alias("at"), "headers", "digest",
        ((F.col("type") == "response") & (F.col("status") == 200)).alias("is_full"),
    ).where("is_revisit OR is_full")
    r = r.withColumn("slice", F.floor(F.col("at") / slice_seconds))
    known = r.where("canonical_url IS NOT NULL AND at IS NOT NULL")
    offer = F.when(F.col("is_full"), F.struct(F.col("at"), F.col("record_id"), F.col("headers"), F.col("digest")))
    slim = known.withColumn("offer", offer)
    within = Window.partitionBy("canonical_url", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = slim.withColumn("near", F.last("offer", ignorenulls=True).over(within)).where("is_revisit")
    latest = slim.where("is_full").groupBy("canonical_url", "slice").agg(F.max_by("offer", F.struct("at", "record_id")).alias("last"))
    asked = slim.where("is_revisit").select("canonical_url", "slice").distinct()
    marks = latest.join(asked, ["canonical_url", "slice"], "full")
    across = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("before", F.last("last", ignorenulls=True).over(across)).select("canonical_url", "slice", "before").where("before IS NOT NULL")
    found = here.join(carried, ["canonical_url", "slice"], "left").withColumn("old", F.coalesce("near", "before"))
    lost = r.where("is_revisit AND (canonical_url IS NULL OR at IS NULL)").select("record_id", "canonical_url", "headers", "digest")
    found = found.select("record_id", "canonical_url", "headers", "digest", "old").unionByName(lost, allowMissingColumns=True)

    def header(name: str, side: str = "") -> Column:
        return F.try_element_at(F.col(f"{side}headers"), F.lit(name))

    new_tag, old_tag = _bare(header("etag")), _bare(header("etag", "old."))
    new_time, old_time = header("last-modified"), header("last-modified", "old.")
    same = F.coalesce(new_tag == old_tag, new_time == old_time, F.col("digest") == F.col("old.digest"))
    outcome = F.when(F.col("old").isNull(), "missing").when(same, "resolved").when(~same, "mismatch").otherwise("unvalidated")
    fresh = F.coalesce(F.map_filter("headers", lambda k, _: k.isin(*PERMITTED)), F.create_map().cast("map<string,string>"))
    stale = F.map_filter(F.coalesce(F.col("old.headers"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(fresh, k))
    return found.select(
        "record_id", "canonical_url", F.when(F.col("old").isNotNull(), F.col("old.record_id")).alias("refers_to"), outcome.alias("outcome"),
        F.when(outcome == "resolved", F.map_concat(stale, fresh)).alias("headers"),
    )


def recrawl(pages: DataFrame) -> DataFrame:
    """WARC records of two crawls of `pages`: the full response of each page, then a not-modified answer a day later.

    Every fourth answer has another etag, every seventh page has none on either side and is validated by its digest.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    bare = F.col("page_id") % 7 == 6

    def headers(etag: Column, kind: str, date: Column) -> Column:
        base = F.create_map(F.lit("content-type"), F.lit(kind), F.lit("date"), date.cast("string"))
        return F.when(bare, base).otherwise(F.map_concat(base, F.create_map(F.lit("etag"), etag)))

    page = F.col("page_id")
    first = pages.select(page.alias("record_id"), F.lit("response").alias("type"), "url", page.alias("captured_at"), F.lit(200).alias("status"), headers(tag, "text/html", page).alias("headers"), F.md5("html").alias("digest"))
    wrong = F.when(page % 4 == 3, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    later = page + 86_400
    second = pages.select((-page - 1).alias("record_id"), F.lit("revisit").alias("type"), "url", later.alias("captured_at"), F.lit(304).alias("status"), headers(wrong, "text/plain", later).alias("headers"), F.md5("html").alias("digest"))
    return first.unionByName(second)
