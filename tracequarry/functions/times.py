"""Column builders for times."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: ISO 8601 dates with or without a time of day and a zone.
_ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?( ?([Zz]|[+-]\d{2}(:?\d{2})?))?)?$"


def parse_time(c: Column, *, drop_zone: bool = False) -> Column:
    """A timestamp from ISO 8601 text, with 'T' or a space, or from epoch milliseconds; null if it is neither. White space around it does not count.

    Text without a zone is UTC, a date alone its midnight. drop_zone: an offset in the text is left off instead of applied.
    """
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    day, time = F.substring(t, 1, 10), F.upper(F.replace(F.substring(t, 12, 60), F.lit(","), F.lit(".")))
    if drop_zone:
        time = F.regexp_replace(time, r" ?(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})$", "")
    time = F.regexp_replace(F.regexp_replace(time, r"([+-]\d{2})$", "$1:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    time = F.regexp_replace(time, r"^(\d{2}:\d{2})(?=$|[ Z+-])", "$1:00")
    text = F.when(F.length(t) > 10, F.concat_ws("T", day, time)).otherwise(day)
    return F.coalesce(F.when(t.rlike(_ISO), text.try_cast("timestamp")), F.when(t.rlike(r"^\d{11,14}$"), F.timestamp_millis(t.try_cast("long"))))


def iso_week(c: Column) -> Column:
    """2026-W05 by ISO year and week; 'unknown' for null."""
    return F.coalesce(F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0")), F.lit("unknown"))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds, negative if the end comes first; null if either is missing."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def covered(ranges: list[tuple[datetime, datetime]], start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """What of start to end the ranges leave out, in order."""
    left, at = [], start
    for a, b in sorted(ranges):
        if a > at:
            left.append((at, min(a, end)))
        at = max(at, b)
    return [(a, b) for a, b in [*left, (at, end)] if a < b]


def progress(ranges: list[tuple[datetime, datetime]], start: datetime, end: datetime) -> float:
    """How much of start to end is done, in percent of time; 100 at most, and for an empty stretch of which something is done."""
    if not ranges:
        return 0.0
    whole = (end - start).total_seconds()
    return 100.0 if whole <= 0 else min(100.0, 100 * sum((b - a).total_seconds() for a, b in ranges) / whole)


def time_left(percent: float, elapsed: timedelta) -> timedelta | None:
    """At this pace; None as long as nothing is done."""
    return None if percent <= 0 or elapsed.total_seconds() <= 0 else elapsed / percent * (100 - percent)


def first_window(whole: timedelta, failures: int, least: timedelta = timedelta(minutes=15)) -> timedelta:
    """The stretch of time to ask a service for at first: halved for each failure before, at most four times, and at least `least` once something has failed."""
    return whole if failures == 0 else max(whole / 2 ** min(failures, 4), least)
