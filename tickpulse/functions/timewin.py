"""Date, time-window and epoch Column functions (inventory 2.10 and the
window anchors of 2.3).

All expressions are independent of the session time zone: the test tables
carry ``timestamp_ntz`` wall-clock values read as UTC, and zones are explicit
parameters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_seconds(ts) -> Column:
    """fn_ts_to_epoch: whole seconds since 1970 of a UTC wall-clock timestamp (floor)."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), _c(ts).cast("timestamp_ntz"))


def epoch_seconds_rounded(ts) -> Column:
    """PostgreSQL ``EXTRACT(EPOCH ...)::bigint`` rounds half away from zero."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(ts).cast("timestamp_ntz"))
    return F.round(micros / F.lit(1_000_000.0)).cast("bigint")


def ts_of_epoch(epoch) -> Column:
    """fn_epoch_to_ts: epoch seconds -> UTC wall-clock ``timestamp_ntz``."""
    return F.timestamp_add("SECOND", _c(epoch).cast("bigint"), F.expr(_EPOCH_NTZ))


def to_zone(ts, zone: str, from_zone: str = "UTC") -> Column:
    """fn_tz_convert: wall clock in ``from_zone`` -> wall clock in ``zone``."""
    return F.convert_timezone(F.lit(from_zone), F.lit(zone), _c(ts).cast("timestamp_ntz"))


def ntz(value) -> Column:
    """A wall-clock timestamp literal, independent of the session and process time zones."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def floor_to(ts, unit: str) -> Column:
    """fn_floor_hour / fn_floor_minute (``unit`` = 'hour' | 'minute' | 'day')."""
    return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")


def as_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def to_epoch(value) -> int:
    """UTC epoch of a naive wall-clock datetime."""
    d = as_datetime(value)
    return int((d - dt.datetime(1970, 1, 1)).total_seconds())


def day_anchor(run_time, hour: int = 0) -> dt.datetime:
    """fn_day_anchor: midnight (or ``hour`` o'clock) of the run day."""
    d = as_datetime(run_time)
    return dt.datetime(d.year, d.month, d.day, hour)


def half_open_day(run_time, hour: int = 0) -> tuple[int, int]:
    """[anchor - 1 day, anchor) as epochs; ``hour`` = 0 (statistics), 7 (YouTube), 8 (rumors)."""
    end = day_anchor(run_time, hour)
    return to_epoch(end - dt.timedelta(days=1)), to_epoch(end)


def interval_bounds(interval: str, run_time) -> tuple[int, int]:
    """agg_interval_bounds: epochs of the roll-up window for '24h', 'week' or 'month'."""
    end = day_anchor(run_time, 8)
    if interval == "24h":
        start = end - dt.timedelta(days=1)
    elif interval.lower() == "week":
        start = end - dt.timedelta(days=end.weekday() + 7)  # fn_week_start: Monday of last week
        end = start + dt.timedelta(days=7)
    elif interval.lower() == "month":
        start = end - dt.timedelta(days=30)
    else:
        raise ValueError(f"unsupported interval {interval!r}: use 24h, week or month")
    return to_epoch(start), to_epoch(end)


def week_start(run_time) -> dt.datetime:
    """fn_week_start: 08:00 on Monday of the week before the run day."""
    end = day_anchor(run_time, 8)
    return end - dt.timedelta(days=end.weekday() + 7)


def normalize_calendar_date(raw, base_date) -> Column:
    """fn_normalize_date: 'Sun Oct 5' + base date -> 'yyyy-MM-dd'.

    Blank -> ''; newlines become spaces; the weekday is not checked against
    the date; a January date seen from a December base moves to next year;
    text that does not parse is returned stripped.
    """
    base = as_datetime(base_date)
    year = base.year
    txt = F.trim(F.regexp_replace(_c(raw), "\n", " "))
    txt = F.regexp_replace(txt, r"(?U)^\s+|\s+$", "")
    parts = F.split(txt, r"\s+")
    parsed = F.when(
        (F.size(parts) == 3) & F.element_at(parts, 1).rlike("^[A-Za-z]{3}$"),
        F.try_to_timestamp(F.concat_ws(" ", F.element_at(parts, 2), F.element_at(parts, 3), F.lit(str(year))),
                           F.lit("MMM d yyyy")),
    )
    parsed_date = F.to_date(parsed)
    bumped = F.when(
        (parsed_date < F.lit(base.date())) & F.lit(base.month == 12) & (F.month(parsed_date) == 1),
        F.add_months(parsed_date, 12),
    ).otherwise(parsed_date)
    blank = F.regexp_replace(_c(raw), r"(?U)\s", "") == ""
    return (
        F.when(_c(raw).isNull(), F.lit(None))
        .when(blank, F.lit(""))
        .when(parsed_date.isNull(), txt)
        .otherwise(F.date_format(bumped, "yyyy-MM-dd"))
    )
