"""Scoreboard text, label lines and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits_clock(d: Column, minutes: tuple[int, int], seconds: tuple[int, int]) -> Column:
    """Seconds of the clock that two runs of digits (first place, length) spell; null if out of range."""
    m, s = F.substring(d, *minutes).cast("int"), F.substring(d, *seconds).cast("int")
    return F.when((m <= 15) & (s <= 59), m * 60 + s)


def clock_candidates(raw: Column) -> Column:
    """Seconds that a noisy clock text may mean, likeliest first, without repeats.

    Look-alike letters become digits. A written clock gives itself or nothing; otherwise three digits are M:SS, four are
    M:SS with one digit too many or MM:SS, five likewise.
    """
    text = F.regexp_replace(F.translate(F.upper(raw), "OILS", "0115"), "[^0-9:.]", "")
    written = text.rlike(r"^\d{1,2}:\d{2}([.]\d)?$")
    m, s = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})", 1), F.regexp_extract(text, r"^(\d{1,2}):(\d{2})", 2)
    own = F.when((m.cast("int") <= 15) & (s.cast("int") <= 59), m.cast("int") * 60 + s.cast("int"))
    d = F.regexp_replace(text, "[^0-9]", "")
    minute, two = (1, 1), (1, 2)
    skip = F.concat(F.substring(d, 2, 1), F.substring(d, 4, 1))
    by_skip = F.when((F.substring(d, 1, 1).cast("int") <= 15) & (skip.cast("int") <= 59), F.substring(d, 1, 1).cast("int") * 60 + skip.cast("int"))
    three = F.array(_digits_clock(d, minute, (2, 2)))
    four = F.array(_digits_clock(d, minute, (3, 2)), _digits_clock(d, minute, (2, 2)), by_skip, _digits_clock(d, two, (3, 2)))
    five = F.array(_digits_clock(d, minute, (3, 2)), _digits_clock(d, minute, (4, 2)), _digits_clock(d, two, (3, 2)))
    found = F.when(written, F.array(own)).when(F.length(d) == 3, three).when(F.length(d) == 4, four).when(F.length(d) == 5, five).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def format_clock(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int")))


def clock_seconds(text: Column) -> Column:
    """Seconds of M:SS; null if the seconds exceed 59 or the text is no clock."""
    m, s = F.regexp_extract(text, r"^(\d+):(\d{1,2})$", 1), F.regexp_extract(text, r"^(\d+):(\d{1,2})$", 2)
    return F.when((m != "") & (s.cast("int") <= 59), m.cast("int") * 60 + s.cast("int"))


def parse_clock(text: Column) -> Column:
    """The first clock candidate, else a bare number of one or two digits up to 35."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    bare = F.when(digits.rlike(r"^\d{1,2}$") & (digits.cast("int") <= 35), digits.cast("int"))
    return F.coalesce(F.try_element_at(clock_candidates(text), F.lit(1)), bare)


def parse_score(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits.rlike(r"^\d{1,9}$"), F.when(digits.cast("int") <= 999, digits.cast("int")))


def parse_quarter(text: Column) -> Column:
    """Overtime n is quarter 4 + n; otherwise the first digit."""
    overtime = F.upper(text).rlike("OT")
    n = F.regexp_extract(F.upper(text), r"(\d)?OT", 1)
    first = F.regexp_extract(text, r"(\d)", 1)
    return F.when(overtime, 4 + F.when(n != "", n.cast("int")).otherwise(1)).when(first != "", first.cast("int"))


def label_line(line: Column) -> Column:
    """A detection label `0 cx cy w h` with six decimals, null if it has another shape, class or range."""
    part = F.split(F.trim(line), r"\s+")
    v = [F.try_element_at(part, F.lit(k)).try_cast("double") for k in range(2, 6)]
    ok = (F.size(part) == 5) & (F.try_element_at(part, F.lit(1)) == "0") & v[0].between(0, 1) & v[1].between(0, 1) & (v[2] > 0) & (v[3] > 0)
    return F.when(ok, F.format_string("0 %.6f %.6f %.6f %.6f", *v))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def url_kind(url: Column) -> Column:
    """youtube by host, direct by a video file's ending, else probe; error without a web address."""
    host, path = url_host(url), F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return F.when(~F.lower(url).rlike("^https?://"), "error").when(host.rlike(r"(^|[.])(youtube[.]com|youtu[.]be)$"), "youtube").when(path.rlike(r"[.](mp4|mov|mkv|webm)$"), "direct").otherwise("probe")


def content_extension(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    known = {"video/mp4": ".mp4", "video/quicktime": ".mov", "video/x-matroska": ".mkv", "video/webm": ".webm"}
    out = F.when(F.lit(False), "")
    for k, v in known.items():
        out = out.when(kind == k, v)
    return out.when(kind.startswith("video/"), ".mp4")


def keypoint_order(text: Column) -> Column:
    """Four comma-separated indices, a permutation of 0 to 3, as an array; null for null, empty and `auto`, and for anything else."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int"))
    return F.when(F.array_sort(parts) == F.array(*[F.lit(k) for k in range(4)]), parts)


def stream_section(start: Column, end: Column) -> Column:
    """The part of a video to ask for, in seconds; null for the whole, and for an end that is not after the start."""
    start = F.greatest(start, F.lit(0))
    return F.when(end > start, F.format_string("*%s-%s", start, end)).when((start > 0) & end.isNull(), F.format_string("*%s-inf", start))


def stream_format(height: Column) -> Column:
    """Formats without sound first, MP4 before others, none higher than `height`."""
    cap = F.format_string("[height<=%s]", height)
    return F.concat(F.lit("bv*"), cap, F.lit("[ext=mp4]/b"), cap, F.lit("[ext=mp4]/bv*"), cap, F.lit("/b"), cap)
