"""Digest and report wording: truncation, escaping, score bands, actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import DEFAULT_ZONE
from .text import collapse_space, let


def truncate(value: Column, limit: int) -> Column:
    """Shorten to ``limit`` characters with a three-dot ending."""
    if limit <= 3:
        return F.substring(value, 1, limit)
    return let(value, lambda v: F.when(F.length(v) <= limit, v).otherwise(
        F.concat(F.rtrim(F.substring(v, 1, limit - 3)), F.lit("..."))))


def first_sentence(value: Column) -> Column:
    return let(collapse_space(value), lambda flat: F.coalesce(
        F.nullif(F.regexp_extract(flat, "^(.+?[.!?])(?:\\s|$)", 1), F.lit("")), flat))


def display_time(ts: Column, zone: Column | str | None = None) -> Column:
    """"Aug 25, 7:00 PM" in the row's zone."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    local = F.from_utc_timestamp(ts, F.coalesce(zone, F.lit(DEFAULT_ZONE)) if zone is not None else F.lit(DEFAULT_ZONE))
    return F.date_format(local, "MMM d, h:mm a")


def escape_html(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def unescape_html(value: Column) -> Column:
    for safe, raw in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        value = F.replace(value, F.lit(safe), F.lit(raw))
    return value


def plain_digest(html: Column) -> Column:
    """Escaped form to plain text; a link becomes "label (url)"."""
    text = F.regexp_replace(html, "(?is)<a\\s+href=\"([^\"]*)\"[^>]*>(.*?)</a>", "$2 ($1)")
    return unescape_html(F.regexp_replace(text, "<[^>]+>", ""))


def escape_markdown(line: Column) -> Column:
    """Backslash-escape markup characters, urls left alone."""
    parts = F.split(F.regexp_replace(line, "(https?://\\S+)", "\u0001$1\u0001"), "\u0001")
    escaped = F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(
        F.regexp_replace(p, "([\\\\`*_\\[\\]<>~|])", "\\\\$1")))
    return F.array_join(escaped, "")


def markdown_digest(html: Column) -> Column:
    """Plain form with headings and hard line breaks."""
    lines = F.split(plain_digest(html), "\n")
    section = "^(Recommended|Possible) \\([0-9]+(-[0-9]+|\\+)\\)$"

    def one(line: Column, i: Column) -> Column:
        text = F.trim(line)
        return (
            F.when(text == "", F.lit(""))
            .when(i == 0, F.concat(F.lit("### "), escape_markdown(text)))
            .when(text.rlike(section), F.concat(F.lit("#### "), text))
            .otherwise(F.concat(escape_markdown(text), F.lit("  ")))
        )

    return F.array_join(F.transform(lines, one), "\n")


def score_tone(score: Column, recommend: int, review: int) -> Column:
    return (F.when(score >= min(100, recommend + 5), "strong").when(score >= recommend, "pass")
            .when(score >= review, "near").otherwise("low"))


def score_label(score: Column, recommend: int, review: int) -> Column:
    tone = score_tone(score, recommend, review)
    return (F.when(tone == "strong", "Strong fit").when(tone == "pass", "Above the bar")
            .when(tone == "near", "Just under the bar").otherwise("Below the bar"))


def action_from_score(score: Column, recommend: int) -> Column:
    return F.when(score >= recommend + 8, "apply").when(score >= recommend, "rsvp").otherwise("monitor")


def action_tone(action: Column) -> Column:
    return F.when(action.isin("apply", "rsvp"), "go").when(action == "ask_intro", "reach").otherwise("wait")
