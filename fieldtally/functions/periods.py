"""Calendar buckets, spans and delays on zone-free timestamps.

Everything here avoids the session time zone: buckets go through DATE, delays through
day numbers, so a cluster with another default zone gives the same answers.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The supported frequencies, with the unit that starts each bucket.
FREQUENCIES = {
    "day": "day",
    "yearweek": "week",
    "month": "month",
    "quarter": "quarter",
    "year": "year",
}

# One bucket forward, as a Spark interval literal.
_STEPS = {
    "day": "INTERVAL 1 DAY",
    "yearweek": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTH",
    "year": "INTERVAL 12 MONTH",
}

_SPAN = re.compile(r"^\s*(\d+)\s+(day|week|month|quarter|year)s?\s*$")
_SPAN_UNITS = {"day": (0, 1), "week": (0, 7), "month": (1, 0), "quarter": (3, 0), "year": (12, 0)}


def _unit(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency {freq!r}, expected one of {sorted(FREQUENCIES)}")
    return FREQUENCIES[freq]


def period_start(ts: Column, freq: str) -> Column:
    """First instant of the bucket holding `ts` (weeks start on Monday), as TIMESTAMP_NTZ."""
    day = ts.cast("date")
    unit = _unit(freq)
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def step(freq: str) -> Column:
    """Length of one bucket."""
    _unit(freq)
    return F.expr(_STEPS[freq])


def parse_span(text: str) -> tuple[int, int]:
    """'1 year' -> (12 months, 0 days)."""
    match = _SPAN.match(text)
    if not match:
        raise ValueError(f"cannot read the span {text!r}")
    months, days = _SPAN_UNITS[match.group(2)]
    n = int(match.group(1))
    return n * months, n * days


def within_span(earlier: Column, later: Column, span: str) -> Column:
    """Whether `later - earlier` is at most `span`, months counting 30 days each.

    A gap between two instants has no calendar, so one year is 360 days here. Compare
    with :func:`calendar_before`, which moves an instant through the real calendar.
    """
    months, days = parse_span(span)
    return (later - earlier) <= F.expr(f"INTERVAL '{months * 30 + days}' DAY")


def calendar_before(instant: Column, span: str) -> Column:
    """`instant` moved back by `span` through the calendar."""
    months, days = parse_span(span)
    moved = instant
    if months:
        moved = moved - F.expr(f"INTERVAL '{months}' MONTH")
    if days:
        moved = moved - F.expr(f"INTERVAL '{days}' DAY")
    return moved


def as_instant(value: dt.datetime | str | Column) -> Column:
    """Column of a zone-free instant from a datetime, an ISO text or a column."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def _minute_number(ts: Column) -> Column:
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 1440 + F.hour(ts) * 60 + F.minute(ts)


def minutes_between(start: Column, end: Column) -> Column:
    """Number of minute boundaries crossed from `start` to `end` (10:00:59 to 10:01:00 is 1)."""
    return _minute_number(end) - _minute_number(start)


def months_since(period: Column, origin: Column) -> Column:
    """Whole 30-day months between the month starts of `origin` and `period`, cut toward zero."""
    gap = F.datediff(F.trunc(period.cast("date"), "month"), F.trunc(origin.cast("date"), "month"))
    return (gap / F.lit(30)).cast("int")


def iso_day(ts: Column) -> Column:
    """`YYYY-MM-DD` text of an instant."""
    return ts.cast("date").cast("string")
