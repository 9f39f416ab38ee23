"""Grouped summaries of cleaned rides.

Every summary is a ``groupBy(...).agg(...)``: Spark runs a partial
(map-side) aggregate before the shuffle, so only one row per key and task
crosses the network and a hot key (one rider type holding a third of all
rides) is absorbed before it can skew a reducer. Summaries over calendar and
category keys also accept the pre-aggregated ``ride_cube`` in place of the
rides (see ``cube``): same result, one scan of the rides for all of them.

Only summaries the reference sorts explicitly (``arrange``) are sorted here;
the implicit key order of a grouped result is presentation, available through
``calendar_order`` for display, and costs no extra range-partitioning job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.clean import casual_rides, short_rides
from cadence.operators.cube import count_of, is_cube, mean_distance, mean_length, short_count
from cadence.operators.lengths import exact_quantiles, lengths_of, mean_of_lengths
from cadence.schema import DAY_NAMES, MONTH_ABBREVIATIONS

# ---------------------------------------------------------------- helpers


def _count(df: DataFrame, name: str) -> Column:
    return count_of(df).alias(name)


def _mean(df: DataFrame, name: str) -> Column:
    return mean_length(df).alias(name)


def summarize(df: DataFrame, keys: list[str], measures: list[Column], order: list[Column | str] | None = None) -> DataFrame:
    """``groupBy(keys).agg(measures)``, optionally sorted."""
    out = df.groupBy(*keys).agg(*measures)
    return out.orderBy(*order) if order else out


def having(df: DataFrame, keys: list[str], count_name: str, min_exclusive: int) -> DataFrame:
    """Groups whose row count exceeds ``min_exclusive`` (aggregate then filter)."""
    return df.groupBy(*keys).agg(_count(df, count_name)).filter(F.col(count_name) > min_exclusive)


def calendar_order(df: DataFrame, *then: str) -> DataFrame:
    """Sort a summary for display: weekday (Sunday first) and month columns in
    calendar order, then ``then`` columns. For small results only."""
    days = F.array_position(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col("day_of_week"))
    keys: list[Column] = []
    if "day_of_week" in df.columns:
        keys.append(days.asc_nulls_last())
    if "month" in df.columns and dict(df.dtypes)["month"] == "string":
        months = F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS]), F.col("month"))
        keys.append(months.asc_nulls_last())
    keys += [F.col(c).asc_nulls_last() for c in then]
    return df.orderBy(*keys)


def _by_day(df: DataFrame, extra_keys: list[str], measures: list[Column]) -> DataFrame:
    return df.groupBy("day_of_week", *extra_keys).agg(*measures)


# ------------------------------------------------------- rider-type shares


def ride_share_by_member_type(rides: DataFrame) -> DataFrame:
    """Rides per rider type and its share of all rides. The share divides by a
    window sum over the (two-row) aggregate, never over raw rides."""
    counts = rides.groupBy("member_casual").agg(_count(rides, "total_rides"))
    total = F.sum("total_rides").over(Window.partitionBy())
    return counts.withColumn("proportion", F.col("total_rides") / total)


def short_rides_summary(rides: DataFrame, max_seconds: float = 60) -> DataFrame:
    """Short rides per rider type (rider types without any are absent). A
    cube fails for a threshold it was not built with."""
    if is_cube(rides):
        return rides.groupBy("member_casual").agg(short_count(rides, max_seconds).alias("count")).filter(F.col("count") > 0)
    return summarize(short_rides(rides, max_seconds), ["member_casual"], [_count(rides, "count")])


# ------------------------------------------------------ rider x bike type


def rides_by_rideable_type_and_member_type(rides: DataFrame) -> DataFrame:
    return summarize(rides, ["member_casual", "rideable_type"], [_count(rides, "ride_count")])


def bike_usage_by_type(rides: DataFrame) -> DataFrame:
    return summarize(rides, ["rideable_type", "member_casual"], [_count(rides, "ride_count")])


def rideable_type_distribution(rides: DataFrame) -> DataFrame:
    return summarize(rides, ["rideable_type", "member_casual"], [_count(rides, "number_of_rides")])


def member_vs_casual_usage(rides: DataFrame) -> DataFrame:
    return summarize(rides, ["member_casual", "rideable_type"], [_mean(rides, "average_ride_length")])


def avg_ride_duration_by_type(rides: DataFrame) -> DataFrame:
    return summarize(rides, ["rideable_type", "member_casual"], [_mean(rides, "average_ride_length")])


# ------------------------------------------------------------ time of week
# (the three "by type and ..." tables are sorted by their keys in the
# reference, weekday in calendar order)


def rides_by_type_and_day(rides: DataFrame) -> DataFrame:
    out = (
        rides.groupBy("member_casual", "rideable_type", "day_of_week_num", "day_of_week")
        .agg(_count(rides, "ride_count"))
        .orderBy("member_casual", "rideable_type", "day_of_week_num")
    )
    return out.drop("day_of_week_num")


def rides_by_type_and_hour(rides: DataFrame) -> DataFrame:
    keys = ["member_casual", "rideable_type", "hour_of_day"]
    return summarize(rides, keys, [_count(rides, "ride_count")], keys)


def rides_by_weekend_weekday(rides: DataFrame) -> DataFrame:
    keys = ["member_casual", "rideable_type", "is_weekend"]
    return summarize(rides, keys, [_count(rides, "ride_count")], keys)


def average_ride_length_by_member(rides: DataFrame) -> DataFrame:
    return summarize(rides, ["member_casual"], [_mean(rides, "average_ride_length")])


def average_ride_length_by_day(rides: DataFrame) -> DataFrame:
    return _by_day(rides, ["member_casual"], [_mean(rides, "average_ride_length")])


def rides_by_day(rides: DataFrame) -> DataFrame:
    return _by_day(rides, ["member_casual"], [_count(rides, "number_of_rides")])


def ride_frequency_by_day(rides: DataFrame) -> DataFrame:
    return _by_day(rides, [], [_count(rides, "ride_count")])


def hourly_rides(rides: DataFrame) -> DataFrame:
    return summarize(rides, ["hour_of_day", "member_casual"], [_count(rides, "ride_count")])


def avg_ride_duration(rides: DataFrame) -> DataFrame:
    """Heat-map data: mean length per weekday x hour."""
    return _by_day(rides, ["hour_of_day"], [_mean(rides, "average_ride_length")])


# ------------------------------------------------------------ length stats


def ride_length_stats(rides: DataFrame, unit_seconds: float = 1.0) -> DataFrame:
    """Mean, median and max length per rider type, from the rides or their
    ``length_table``; all three are exact (see ``lengths``).

    ``unit_seconds=60`` reports minutes; statistics are taken on seconds and
    scaled, which is the same number without extra rounding.
    """
    s = F.lit(float(unit_seconds))
    lengths = lengths_of(rides)
    stats = lengths.groupBy("member_casual").agg(mean_of_lengths().alias("__mean"), F.max("ride_length").alias("__max"))
    medians = exact_quantiles(lengths, [0.5]).select(F.col("member_casual").alias("__g"), F.col("q0").alias("__median"))
    return stats.join(medians, F.col("member_casual").eqNullSafe(F.col("__g"))).select(
        "member_casual",
        (F.col("__mean") / s).alias("average_ride_length"),
        (F.col("__median") / s).alias("median_ride_length"),
        (F.col("__max") / s).alias("max_ride_length"),
    )


def ride_length_stats_minutes(rides: DataFrame) -> DataFrame:
    return ride_length_stats(rides, 60.0)


# ------------------------------------------------------------------ months


def monthly_rides(rides: DataFrame) -> DataFrame:
    """Rides per abbreviated month label (years pooled) x rider type."""
    return rides.groupBy(F.col("month_label").alias("month"), "member_casual").agg(_count(rides, "ride_count"))


def rides_by_month(rides: DataFrame) -> DataFrame:
    """Rides per calendar month (years kept apart) x rider type."""
    return rides.groupBy(F.col("month_start").alias("month"), "member_casual").agg(_count(rides, "number_of_rides"))


def monthly_ride_count(rides: DataFrame) -> DataFrame:
    """Rides per full month name (plain text, so it sorts alphabetically)."""
    return rides.groupBy(F.col("month_name").alias("month")).agg(_count(rides, "total_rides"))


def bike_usage_by_month_type(rides: DataFrame) -> DataFrame:
    return rides.groupBy("rideable_type", F.col("month_label").alias("month"), "member_casual").agg(_count(rides, "ride_count"))


# ------------------------------------------------- places, ids, distances


def ride_count_by_location(rides: DataFrame) -> DataFrame:
    """Rides per exact start/end coordinate pair x rider type (high
    cardinality: hash-partitioned, not sorted)."""
    return rides.groupBy("start_lat", "start_lng", "end_lat", "end_lng", "member_casual").agg(_count(rides, "number_of_rides"))


def frequent_casual_riders(rides: DataFrame, min_rides_exclusive: int = 5) -> DataFrame:
    """Casual ride ids seen more than ``min_rides_exclusive`` times."""
    return having(casual_rides(rides), ["ride_id"], "number_of_rides", min_rides_exclusive)


def ride_repetition(rides: DataFrame, min_rides_exclusive: int = 1) -> DataFrame:
    """(ride id, rider type) pairs seen more than once: duplicate trips."""
    return having(rides, ["ride_id", "member_casual"], "number_of_rides", min_rides_exclusive)


def average_trip_distance(rides: DataFrame) -> DataFrame:
    """Mean straight-line distance per rider type (rides or ``ride_cube``)."""
    return summarize(rides, ["member_casual"], [mean_distance(rides).alias("average_trip_distance")])


def station_utilization(rides: DataFrame, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Rides and distinct ride ids per start station, busiest first.

    A null ride id counts as one more distinct value. ``count_distinct`` is
    planned as a two-level aggregate keyed by (station, ride_id) first, so a
    busy station is spread over many reducers. ``exact=False`` uses a
    HyperLogLog++ sketch (``approx_count_distinct``, one shuffle, fixed-size
    buffers).
    """
    distinct = F.count_distinct("ride_id") if exact else F.approx_count_distinct("ride_id", rsd)
    out = rides.groupBy("start_station_name").agg(
        _count(rides, "station_rides"),
        (distinct + F.max(F.col("ride_id").isNull().cast("int"))).alias("unique_bikes"),
    )
    return busiest_first(out)


def busiest_first(utilization: DataFrame) -> DataFrame:
    return utilization.orderBy(F.col("station_rides").desc(), F.col("start_station_name").asc_nulls_last())
