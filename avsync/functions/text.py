"""Column functions on URLs, clock texts, titles and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from avsync import fixed

SPACE = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value worked out once per row."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def first_case(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first condition that holds, else the default."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def extract_video_id(url: Column, policy: str = "lenient") -> Column:
    """The 11-character id; see ``fixed.VIDEO_ID_PATTERNS``.

    No id: ``strict`` raises, ``lenient`` and ``client`` give NULL, ``batch`` gives the URL.
    """
    subject = strip(url) if policy == "client" else url
    flags = "(?U)" if policy == "strict" else ""
    tries = [F.nullif(F.regexp_extract(subject, flags + p, 1), F.lit("")) for p in fixed.VIDEO_ID_PATTERNS[policy]]
    if policy == "batch":
        tries.append(url)
    if policy == "strict":
        tries.append(F.raise_error(F.concat(F.lit("no video id in "), F.coalesce(url, F.lit("NULL")))).cast("string"))
    return F.coalesce(*tries)


def is_video_url(url: Column) -> Column:
    return F.coalesce(url.rlike(fixed.VIDEO_ID_PATTERNS["lenient"][0]), F.lit(False))


def _whole(seconds: Column) -> Column:
    return F.floor(seconds).cast("long")


def _minutes(seconds: Column) -> Column:
    return F.floor(_whole(seconds) / 60).cast("long")


def format_mmss(seconds: Column, client: bool = False) -> Column:
    """MM:SS without hours; the client form does not pad the minutes."""
    return F.format_string("%d:%02d" if client else "%02d:%02d", _minutes(seconds), F.pmod(_whole(seconds), F.lit(60)))


def format_mmss_ms(seconds: Column) -> Column:
    """MM:SS.mmm, milliseconds cut off."""
    millis = F.floor((seconds - _whole(seconds)) * 1000).cast("long")
    return F.format_string("%02d:%02d.%03d", _minutes(seconds), F.pmod(_whole(seconds), F.lit(60)), millis)


def parse_clock(clock: Column) -> Column:
    """Seconds of "M:S" or "H:M:S"; 0 for any other number of parts."""
    parts = F.transform(F.split(clock, ":"), lambda p: p.try_cast("double"))
    two = parts[0] * 60 + parts[1]
    three = F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))
    return F.when(F.size(parts) == 2, two).when(F.size(parts) == 3, three).otherwise(F.lit(0.0))


def frame_name(number: Column, seconds: Column, legacy: bool = False) -> Column:
    """frame_NNNN_MM_SS.jpg; the legacy form adds hours."""
    s, n = _whole(seconds), number.cast("long")
    if not legacy:
        return F.format_string("frame_%04d_%02d_%02d.jpg", n, _minutes(seconds), F.pmod(s, F.lit(60)))
    hours = F.floor(s / 3600).cast("long")
    minutes = F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    return F.format_string("frame_%04d_%02d_%02d_%02d.jpg", n, hours, minutes, F.pmod(s, F.lit(60)))


def segment_end(start: Column, duration: Column) -> Column:
    return F.coalesce(start, F.lit(0.0)) + F.coalesce(duration, F.lit(0.0))


def title_from_text(text: Column, content_type: Column) -> Column:
    """First six words, first letter large; the content type if there is no text."""
    cleaned = F.trim(F.regexp_replace(text, SPACE, " "))
    words = F.array_join(F.slice(F.split(cleaned, " "), 1, 6), " ")
    source = F.when(F.coalesce(text, F.lit("")) == "", content_type).otherwise(words)
    return F.concat(F.upper(F.substring(source, 1, 1)), F.substr(source, F.lit(2)))


def explanation_parts(text: Column) -> Column:
    """Struct subtitle, paragraphs, key_insight of a text with blank-line paragraphs."""
    raw = F.split(F.coalesce(text, F.lit("")), r"\n{2,}")
    clean = F.filter(F.transform(raw, lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != "")
    first = F.get(F.split(F.get(clean, F.lit(0)), "[.!?]"), F.lit(0))
    long = F.size(clean) > 2
    return F.struct(
        F.coalesce(strip(F.concat(first, F.lit("."))), F.lit("")).alias("subtitle"),
        F.when(long, F.slice(clean, F.lit(1), F.size(clean) - 1)).otherwise(clean).alias("paragraphs"),
        F.when(long, F.try_element_at(clean, F.lit(-1))).otherwise(F.lit("")).alias("key_insight"),
    )


def split_sentences(text: Column) -> Column:
    """Cut after . ! ? before white space; no text gives no sentences."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(F.split(text, r"(?U)(?<=[.!?])\s+"))


def squash_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE, " "))


def is_long_text(text: Column, limit: int = 1000) -> Column:
    return F.length(squash_whitespace(text)) > limit


def job_stage(progress: Column) -> Column:
    return (
        F.when(progress < 20, "downloading")
        .when(progress < 45, "extracting")
        .when(progress < 80, "detecting")
        .when(progress < 100, "generating")
        .otherwise("done")
    )


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


def thumbnail_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://i.ytimg.com/vi/"), video_id, F.lit("/hqdefault.jpg"))


def served_url(path: Column, base: str = "http://127.0.0.1:8000/", data_base: str = "data-url:") -> Column:
    """URL of a stored file: http kept, data folder under ``data_base``, else under ``base``."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "")
        .when(path.startswith("http"), path)
        .when(path.startswith("data"), F.concat(F.lit(data_base), path))
        .otherwise(F.concat(F.lit(base), F.regexp_replace(path, r"^\./", "")))
    )


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def total_ms(nanoseconds: Column) -> Column:
    return F.floor(F.coalesce(nanoseconds, F.lit(0)) / 1_000_000).cast("long")


def word_count(text: Column) -> Column:
    """Words between white space, the token estimate."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def saved_key(video_id: Column, point_id: Column) -> Column:
    return F.concat_ws("-", video_id, point_id)


def timeline_x(seconds: Column, total: Column, left: float = 72.0, right: float = 20.0, width: float = 760.0) -> Column:
    """Offset of a time on a lane of the given width."""
    return F.lit(left) + seconds / total * F.lit(width - left - right)


def ruler_ticks(total: Column) -> Column:
    """Evenly spaced seconds from 0 to total, one per minute, six at most."""
    n = F.least(F.lit(6), F.ceil(total / 60) + 1).cast("int")
    return F.when(
        n >= 2, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * (total / (n - 1)) + 0.5).cast("long"))
    )
