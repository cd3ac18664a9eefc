"""Dates, durations and decimal years, on timestamps without time zone, which are taken as UTC."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(t: Column) -> Column:
    """Microseconds since 1970, of a timestamp without time zone, whatever the session's time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def midpoint(first: Column, second: Column) -> Column:
    return (first + (second - first) / F.lit(2)).cast("timestamp_ntz")


def days_between(first: Column, second: Column) -> Column:
    return F.abs(micros(second) - micros(first)) / F.lit(86_400_000_000.0)


def bounds(start: str, end: str) -> tuple[dt.datetime, dt.datetime]:
    """The first instant, and the first one beyond: a bare end date takes in its whole day, an end time itself."""

    def parsed(text: str) -> dt.datetime:
        t = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t

    beyond = dt.timedelta(days=1) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", end.strip()) else dt.timedelta(microseconds=1)
    first, last = parsed(start), parsed(end) + beyond
    if first >= last:
        raise ValueError("the start is after the end")
    return first, last


def within(t: Column, start: str, end: str) -> Column:
    first, last = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in bounds(start, end))
    return (t >= first) & (t < last)


def decimal_year(t: Column) -> Column:
    """The year, plus the elapsed share of it; leap years are longer."""
    year = F.year(t)
    begin = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    end = F.make_date(year + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return year + (micros(t) - micros(begin)).cast("double") / (micros(end) - micros(begin)).cast("double")


def template_dates(start: str, end: str, step_days: int) -> list[dt.datetime]:
    """Dates from start by steps; the end is added if a step doesn't meet it."""
    first, last = (dt.datetime.fromisoformat(x) for x in (start, end))
    if first >= last or step_days < 1:
        raise ValueError("dates must rise by at least a day")
    out = [first + dt.timedelta(days=d) for d in range(0, (last - first).days + 1, step_days)]
    return out if out[-1] == last else [*out, last]
