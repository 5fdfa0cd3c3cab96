"""Explicit dates in text, the date window, local dates and week bounds."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Words that make a bare past year count as a date, grouped by length.
EVENT_CONTEXT = [
    "event", "meetup", "dinner", "breakfast", "salon", "conference", "summit", "workshop",
    "demo", "panel", "rsvp", "luma", "eventbrite",
]
CONTEXT_REACH = 80
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_START, _END = "(?<![a-z0-9_])", "(?![a-z0-9_])"
_ISO = f"{_START}20[0-9]{{2}}[-/_](?:0?[1-9]|1[0-2])[-/_](?:0?[1-9]|[12][0-9]|3[01]){_END}"
_NAMED = (
    f"{_START}(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    "|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?\\s+[0-3]?[0-9](?:st|nd|rd|th)?"
    f"(?:,?\\s+20[0-9]{{2}})?{_END}"
)


def _bare_year() -> str:
    """A four-digit year with a context word wholly inside the 80 characters on either side.

    The year itself is tested first, as the look-around is dear at every other place of a text.
    """
    tests = []
    for length in sorted({len(w) for w in EVENT_CONTEXT}):
        group = "|".join(w for w in EVENT_CONTEXT if len(w) == length)
        gap = CONTEXT_REACH - length
        tests += [f"(?<=(?:{group})[\\s\\S]{{0,{gap}}})", f"(?=[\\s\\S]{{0,{gap}}}(?:{group}))"]
    return f"{_START}(?=20[0-9]{{2}}{_END})(?:{'|'.join(tests)})20[0-9]{{2}}"


_BARE_YEAR = _bare_year()


def explicit_dates(text: Column, as_of: date) -> Column:
    """array<date> of every explicit date in ``text``; impossible dates are dropped.

    Covers numeric dates, month-name dates (missing year = the year of ``as_of``), and bare
    past years near an event word, which count as January 1st.
    """
    return let(F.lower(text), lambda lower: _dates_in(lower, as_of))


def _dates_in(lower: Column, as_of: date) -> Column:
    iso = F.transform(
        F.regexp_extract_all(lower, F.lit(_ISO), F.lit(0)),
        lambda m: F.try_to_date(F.regexp_replace(m, "[/_]", "-"), "y-M-d"),
    )

    def named_date(m: Column) -> Column:
        month = ((F.instr(F.lit(_MONTHS), F.substring(m, 1, 3)) + 2) / 3).cast("int")
        day = F.regexp_extract(m, "^[a-z]+\\.?\\s+([0-9]{1,2})", 1)
        year = F.coalesce(F.nullif(F.regexp_extract(m, "\\s(20[0-9]{2})$", 1), F.lit("")), F.lit(str(as_of.year)))
        return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")

    named = F.transform(F.regexp_extract_all(lower, F.lit(_NAMED), F.lit(0)), named_date)
    years = F.transform(
        F.filter(F.regexp_extract_all(lower, F.lit(_BARE_YEAR), F.lit(0)), lambda y: y < str(as_of.year)),
        lambda y: F.try_to_date(F.concat(y, F.lit("-1-1")), "y-M-d"),
    )
    found = F.filter(F.concat(iso, named, years), lambda d: d.isNotNull())
    # Nearly all text holds no year and no month name: skip the array work for it.
    may_hold_date = lower.rlike("20[0-9]{2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")
    return F.when(may_hold_date, found).otherwise(F.array().cast("array<date>"))


def has_past_date(dates: Column, as_of: date) -> Column:
    return F.coalesce(F.exists(dates, lambda d: d < F.lit(as_of)), F.lit(False))


def has_future_date(dates: Column, as_of: date) -> Column:
    return F.coalesce(F.exists(dates, lambda d: d >= F.lit(as_of)), F.lit(False))


def parse_time(value: Column) -> Column:
    """Timestamp of an ISO date or date-time string; null when it does not parse."""
    return F.try_to_timestamp(value)


def window_reason(start: Column, as_of: datetime, raw: Column | None = None, months: int = 1) -> Column:
    """Why a start time is outside the window, or null.

    ``raw`` is the text ``start`` was parsed from: present but unparsed means invalid.
    """
    now = F.lit(as_of)
    raw = start.cast("string") if raw is None else raw
    return (
        F.when(raw.isNull() | (raw == ""), "missing_date")
        .when(start.isNull(), "invalid_date")
        .when(start <= now, "past_event")
        .when(start > now + F.make_interval(months=F.lit(months)), "too_far_future")
    )


def local_date(ts: Column, zone: Column | None = None, raw: Column | None = None) -> Column:
    """yyyy-MM-dd of ``ts`` in the row's own zone (UTC when none).

    With ``raw``, an unparseable value falls back to its first ten characters.
    """
    local = ts if zone is None else F.from_utc_timestamp(ts, F.coalesce(F.nullif(zone, F.lit("")), F.lit("UTC")))
    key = F.date_format(local, "yyyy-MM-dd")
    if raw is None:
        return key
    return F.coalesce(key, F.nullif(F.substring(raw, 1, 10), F.lit("")), F.when(raw.isNotNull(), F.lit("invalid-date")))


def hunt_week(as_of: datetime) -> tuple[date, date]:
    """(start, end) of the look-back week: the day of ``as_of`` and seven days before it."""
    end = as_of.date()
    return date.fromordinal(end.toordinal() - 7), end


def duration_seconds(started: Column, finished: Column, status: Column) -> Column:
    """Whole seconds between start and finish; null while running or when an end is missing."""
    seconds = F.floor((F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6 + 0.5)
    return F.when(finished.isNotNull() & (status != "running"), F.greatest(F.lit(0).cast("long"), seconds.cast("long")))
