"""Derived ride columns (seconds, minutes, weekday, hour, weekend, months,
distance). One ``withColumns`` projection: no shuffle, one codegen span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions import columns as C

FEATURE_COLUMNS = [
    "ride_length",
    "ride_length_min",
    "day_of_week_num",
    "day_of_week",
    "hour_of_day",
    "is_weekend",
    "month_num",
    "month_label",
    "month_start",
    "month_name",
    "trip_distance",
]


def add_ride_length(df: DataFrame) -> DataFrame:
    return df.withColumn("ride_length", C.ride_length_seconds())


def add_ride_length_minutes(df: DataFrame) -> DataFrame:
    return df.withColumn("ride_length_min", C.ride_length_minutes(C.ride_length_seconds()))


def add_day_of_week(df: DataFrame) -> DataFrame:
    return df.withColumns({"day_of_week_num": C.day_of_week_num(), "day_of_week": C.day_of_week()})


def add_hour_of_day(df: DataFrame) -> DataFrame:
    return df.withColumn("hour_of_day", C.hour_of_day())


def add_is_weekend(df: DataFrame) -> DataFrame:
    return df.withColumn("is_weekend", C.is_weekend(C.day_of_week()))


def add_month_label(df: DataFrame) -> DataFrame:
    return df.withColumns({"month_num": C.month_num(), "month_label": C.month_label()})


def add_month_start(df: DataFrame) -> DataFrame:
    return df.withColumn("month_start", C.month_start())


def add_month_name(df: DataFrame) -> DataFrame:
    return df.withColumn("month_name", C.month_name())


def add_trip_distance(df: DataFrame) -> DataFrame:
    return df.withColumn("trip_distance", C.trip_distance())


def add_features(df: DataFrame) -> DataFrame:
    """All derived columns at once."""
    length = C.ride_length_seconds()
    return df.withColumns(
        {
            "ride_length": length,
            "ride_length_min": C.ride_length_minutes(length),
            "day_of_week_num": C.day_of_week_num(),
            "day_of_week": C.day_of_week(),
            "hour_of_day": C.hour_of_day(),
            "is_weekend": C.is_weekend(C.day_of_week()),
            "month_num": C.month_num(),
            "month_label": C.month_label(),
            "month_start": C.month_start(),
            "month_name": C.month_name(),
            "trip_distance": C.trip_distance(),
        }
    )


def with_column(df: DataFrame, name: str, expr) -> DataFrame:
    """Add or replace one column (``F.expr`` text or a Column)."""
    return df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """``df`` without ``column``; a name it does not have is an error, unlike with ``drop``."""
    if column not in df.columns:
        raise ValueError(f"no column {column} to drop; there are {df.columns}")
    return df.select(*[c for c in df.columns if c != column])
