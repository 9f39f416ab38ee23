"""Derived ride columns as Catalyst expressions.

All of them work on ``TIMESTAMP_NTZ`` inputs, so no session time zone is
involved: a ride's wall-clock start decides its weekday, hour and month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.schema import DAY_NAMES, WEEKEND_DAYS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ride_length_seconds(started: str | Column = "started_at", ended: str | Column = "ended_at") -> Column:
    """Elapsed seconds as a double. The difference is a day-time interval
    (whole microseconds, no session zone involved) and only then scaled."""
    return (_c(ended) - _c(started)).cast("interval second").cast("decimal(20, 6)").cast("double")


def ride_length_minutes(seconds: str | Column = "ride_length") -> Column:
    return _c(seconds) / F.lit(60.0)


def day_of_week_num(ts: str | Column = "started_at") -> Column:
    """1 = Sunday ... 7 = Saturday (the calendar order used for sorting)."""
    return F.dayofweek(_c(ts))


def day_of_week(ts: str | Column = "started_at") -> Column:
    """Full English weekday name."""
    return F.date_format(_c(ts), "EEEE")


def day_label(index: str | Column) -> Column:
    """Weekday label for a 1-based, Sunday-first index."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), _c(index).cast("int"))


def hour_of_day(ts: str | Column = "started_at") -> Column:
    return F.hour(_c(ts))


def is_weekend(day_name: str | Column = "day_of_week") -> Column:
    """'Weekend' for Saturday/Sunday, otherwise (null included) 'Weekday'."""
    return F.when(_c(day_name).isin(*WEEKEND_DAYS), F.lit("Weekend")).otherwise(F.lit("Weekday"))


def month_num(ts: str | Column = "started_at") -> Column:
    return F.month(_c(ts))


def month_label(ts: str | Column = "started_at") -> Column:
    """Abbreviated month name (years pooled); sort by ``month_num``."""
    return F.date_format(_c(ts), "MMM")


def month_start(ts: str | Column = "started_at") -> Column:
    """First instant of the ride's month, kept as ``TIMESTAMP_NTZ``."""
    t = _c(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def month_name(ts: str | Column = "started_at") -> Column:
    """Full month name as plain text (sorts alphabetically)."""
    return F.date_format(_c(ts), "MMMM")


def trip_distance(
    start_lat: str | Column = "start_lat",
    start_lng: str | Column = "start_lng",
    end_lat: str | Column = "end_lat",
    end_lng: str | Column = "end_lng",
) -> Column:
    """Straight-line distance in degrees. Squares are written as products so
    every engine rounds them the same way."""
    dlat = _c(end_lat) - _c(start_lat)
    dlng = _c(end_lng) - _c(start_lng)
    return F.sqrt(dlat * dlat + dlng * dlng)
