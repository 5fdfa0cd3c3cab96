"""Text normalisation, tokens, similarity, HTML and feed text."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title stop words, dedupe and report forms.
DEDUPE_STOP_WORDS = [
    "a", "an", "and", "at", "bay", "area", "by", "edition", "event", "events", "for",
    "in", "meetup", "networking", "of", "on", "sf", "san", "francisco", "the", "to", "with",
]
REPORT_STOP_WORDS = [
    "a", "an", "and", "area", "bay", "event", "events", "for", "in", "meetup",
    "networking", "of", "on", "sf", "san", "francisco", "the", "to", "with",
]
# Words a query fingerprint ignores.
FINGERPRINT_STOP_WORDS = ["the", "and", "for", "with", "from", "events", "event", "upcoming"]


#: Characters that the word forms below keep; all others part words.
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789+&#@"


@functools.lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters with a compatibility form (NFKD without marks) that holds kept characters: (letters, their one character each, letters with longer forms).

    Other letters part words, whatever their form, and upper-case letters never come, as texts are lower-cased.
    """
    letters, targets, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        if not unicodedata.decomposition(letter) or letter.lower() != letter:
            continue
        form = "".join(c for c in unicodedata.normalize("NFKD", letter) if not 0x300 <= ord(c) <= 0x36F)
        if not set(form) & set(KEPT):
            continue
        if len(form) == 1:
            letters.append(letter)
            targets.append(form)
        else:
            several[letter] = form
    return "".join(letters), "".join(targets), several


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Without this a deeply nested expression repeats its input at every mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(value: Column) -> Column:
    """Trim spaces, tabs and line ends (``trim`` alone drops only spaces)."""
    return F.trim(value, F.lit(" \t\n\r\f\u00a0\ufeff"))


def fold_accents(value: Column) -> Column:
    """Lowercase; every letter, also one with several, in its compatibility form without accents, in the JVM.

    Letters whose form holds none of ``KEPT`` stay as they are: the word forms drop them either way.
    """
    return let(F.lower(value), _folded)


def _folded(lowered: Column) -> Column:
    letters, targets, several = _folds()
    folded = F.translate(F.regexp_replace(lowered, "[\u0300-\u036f]", ""), letters, targets)
    forms = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    longer = F.array_join(F.transform(F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(forms, c), c)), "")
    has_longer = F.length(F.translate(lowered, "".join(several), "")) < F.length(lowered)
    return F.when(~lowered.rlike("[^\\x00-\\x7F]"), lowered).when(has_longer, longer).otherwise(folded)


def _runs_of(value: Column, kept: str) -> Column:
    """All runs of ``kept`` characters, space-joined; cutting them out costs a fraction of replacing what lies between."""
    return F.array_join(F.regexp_extract_all(value, F.lit(kept), F.lit(0)), " ")


def match_text(value: Column) -> Column:
    """Lowercase, accent-free words; keeps ``+ & # @`` inside the text."""
    return _runs_of(fold_accents(value), "[a-z0-9+&#@]+")


def title_text(value: Column) -> Column:
    """Lowercase, accent-free words, letters and digits only."""
    return _runs_of(fold_accents(value), "[a-z0-9]+")


def plain_title(value: Column) -> Column:
    """Known-title form: no accent folding."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def history_text(value: Column) -> Column:
    """History form: ``&amp;`` counts as the word "and"; null counts as empty."""
    unescaped = F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("&amp;"), F.lit("and"))
    return F.trim(F.regexp_replace(unescaped, "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Non-empty space-separated words."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def title_tokens(title: Column, stop_words: list[str] = DEDUPE_STOP_WORDS) -> Column:
    """Distinct title words longer than one letter, stop words removed."""
    kept = F.filter(F.split(title_text(title), " "), lambda w: F.length(w) > 1)
    return F.array_except(kept, F.array(*[F.lit(w) for w in stop_words]))


def query_fingerprint(value: Column) -> Column:
    """Distinct content words of a query, space-joined, in first-seen order."""
    text = F.regexp_replace(F.lower(value), "(?<![a-z0-9_])20[0-9]{2}(?![a-z0-9_])", "")
    text = F.regexp_replace(text, "site:[^\\s)]+", "")
    parts = F.filter(F.split(text, "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    stop = F.array(*[F.lit(w) for w in FINGERPRINT_STOP_WORDS])
    return F.array_join(F.array_except(parts, stop), " ")


def jaccard(left: Column, right: Column) -> Column:
    """Shared tokens over all tokens; 0 when either side is empty."""
    shared, total = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), shared / total).otherwise(F.lit(0.0))


def overlap(left: Column, right: Column) -> Column:
    """Shared tokens over the smaller side; 0 when either side is empty."""
    shared = F.size(F.array_intersect(left, right))
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, shared / smaller).otherwise(F.lit(0.0))


def label_slug(value: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(match_text(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit("topic")).otherwise(slug)


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty, distinct."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array()), trim_space), lambda v: v != ""))


def union_lists(left: Column, right: Column) -> Column:
    return clean_list(F.concat(F.coalesce(left, F.array()), F.coalesce(right, F.array())))


# --- HTML and feed text ---------------------------------------------------------------

_SCRIPT = "(?is)<script.*?</script>"
_STYLE = "(?is)<style.*?</style>"
_TAG = "<[^>]+>"
_NO_SPACE = "[^\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def collapse_space(value: Column) -> Column:
    return _runs_of(value, _NO_SPACE)


def strip_tags(html: Column) -> Column:
    text = F.regexp_replace(html, _SCRIPT, " ")
    text = F.regexp_replace(text, _STYLE, " ")
    return F.regexp_replace(text, _TAG, " ")


def decode_entities(value: Column, nbsp: bool = False) -> Column:
    """The five markup entities, ``&amp;`` first as the reference does; optionally ``&nbsp;``."""
    pairs = [("&nbsp;", " ")] if nbsp else []
    pairs += [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
    for entity, text in pairs:
        value = F.replace(value, F.lit(entity), F.lit(text))
    return value


def html_to_text(html: Column) -> Column:
    return collapse_space(decode_entities(strip_tags(html), nbsp=True))


def readable_text(html: Column) -> Column:
    """Text of the first main, else article, else body block, else the whole page."""
    block = F.coalesce(*[
        F.nullif(F.regexp_extract(html, f"(?is)<{tag}.*?</{tag}>", 0), F.lit("")) for tag in ("main", "article", "body")
    ], html)
    return html_to_text(block)


def cap_page_text(text: Column, max_chars: int = 24_000) -> Column:
    """The page-text length cap, which marks what it shortens."""
    marked = F.concat(F.substring(text, 1, max_chars), F.lit("\n[truncated]"))
    return F.when(F.length(text) > max_chars, marked).otherwise(text)


def html_title(html: Column) -> Column:
    """Decoded ``<title>``; null when missing or empty."""
    raw = F.nullif(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return F.trim(decode_entities(strip_tags(raw)))


def canonical_link(html: Column) -> Column:
    """Href of ``<link rel=canonical>``; null when missing."""
    pattern = "(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)[\"']"
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_words(html: Column) -> Column:
    """The page's whole text on one line."""
    return collapse_space(decode_entities(strip_tags(html)))


def feed_text(value: Column) -> Column:
    unwrapped = F.regexp_replace(value, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1")
    return collapse_space(decode_entities(F.regexp_replace(unwrapped, _TAG, " ")))


def feed_tag(block: Column, tag: str) -> Column:
    """Clean text of the first ``<tag>`` in a feed block; null when missing or empty."""
    raw = F.regexp_extract(block, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)
    return feed_text(F.nullif(raw, F.lit("")))


def urls_in_text(text: Column) -> Column:
    """Distinct http(s) urls with trailing punctuation removed."""
    found = F.regexp_extract_all(text, F.lit("(?i)https?://[^\\s<>\"')\\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))


# --- Ids and hashes -------------------------------------------------------------------


def stable_id(*parts: Column) -> Column:
    """First 24 hex digits of SHA-1 over the newline-joined parts (null counts as empty)."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("\n", *filled)), 1, 24)


def polynomial_hash(value: Column) -> Column:
    """h = h*31 + code, modulo 2^32, over the characters of ``value``."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
