"""One pre-aggregated table for all low-cardinality summaries.

Most summaries are counts, means and maxima of ride length grouped by some
of: rider type, bike type, weekday, hour, month. Instead of one scan of the
rides per summary, ``ride_cube`` aggregates the cleaned rides once to one row
per (rider type, bike type, weekday, hour, calendar month) cell — at most
2 x 3 x 7 x 24 x months rows, independent of the number of rides — with the
ride count, the short-ride count (and its threshold), the length sum, the
length maximum, and the sum and count of distances.
The summary functions accept this cube in place of the rides and re-aggregate
it (``sum`` of counts, ``sum``/``sum`` for means, ``max`` of maxima). Lengths
are summed as decimal seconds with six digits, which is what a length holds:
sums are exact in any order, so means equal the direct ones to the last bit.
Distances are summed in whole steps of 2^-40 degrees for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import columns as C
from cadence.operators.elapsed import unit_of

CUBE_KEYS = ["member_casual", "rideable_type", "day_of_week_num", "day_of_week", "hour_of_day", "month_start"]
CUBE_MEASURES = ["n", "n_short", "short_seconds", "len_sum", "len_max", "dist_sum", "dist_n"]
LENGTH = "ride_length"
DISTANCE = "trip_distance"
#: Steps of a degree in which distances are summed. A power of two, so scaling rounds
#: nothing; a distance is off by half a step at most, 4.6e-13 degrees.
DISTANCE_STEPS = float(1 << 40)


def exact_seconds(length_col: str = LENGTH) -> Column:
    """A length as whole microseconds in decimal seconds; sums of it do not
    depend on their order."""
    return F.col(length_col).cast("decimal(20, 6)")


def exact_distance(distance_col: str = DISTANCE) -> Column:
    """A distance in whole steps; sums of it do not depend on their order."""
    return F.floor(F.col(distance_col) * F.lit(DISTANCE_STEPS) + F.lit(0.5)).cast("decimal(20, 0)")


def _measures(cleaned: DataFrame, short_seconds: float) -> list[Column]:
    x = F.col(LENGTH)
    # rides without a distance column have a cube all the same
    far = exact_distance() if DISTANCE in cleaned.columns else F.lit(None).cast("decimal(20, 0)")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(x < short_seconds).alias("n_short"),
        F.max(F.lit(float(short_seconds))).alias("short_seconds"),
        F.sum(exact_seconds()).alias("len_sum"),
        # the unit in which lengths are shown travels along
        F.max(x).alias("len_max", metadata=cleaned.schema[LENGTH].metadata),
        F.sum(far).alias("dist_sum"),
        F.count(far).alias("dist_n"),
    ]


def ride_cube(cleaned: DataFrame, short_seconds: float = 60) -> DataFrame:
    cube = cleaned.groupBy(*CUBE_KEYS).agg(*_measures(cleaned, short_seconds))
    # calendar labels of the cell, derived from its keys (same expressions as
    # the ride features)
    return _with_calendar(cube)


def is_cube(df: DataFrame) -> bool:
    return all(c in df.columns for c in CUBE_MEASURES)


def count_of(df: DataFrame) -> Column:
    """Number of rides: ``count(*)`` on rides, ``sum(n)`` on the cube."""
    return F.sum("n") if is_cube(df) else F.count(F.lit(1))


def _only_length(length_col: str) -> None:
    if length_col != LENGTH:
        raise ValueError(f"the ride cube summarises {LENGTH}, not {length_col}; pass the rides")


def mean_length(df: DataFrame, length_col: str = LENGTH) -> Column:
    if is_cube(df):
        _only_length(length_col)
        return F.sum("len_sum").cast("double") / F.sum("n")
    return F.sum(exact_seconds(length_col)).cast("double") / F.count(length_col)


def max_length(df: DataFrame, length_col: str = LENGTH) -> Column:
    if is_cube(df):
        _only_length(length_col)
        return F.max("len_max")
    return F.max(length_col)


def mean_distance(df: DataFrame) -> Column:
    """Mean distance of rides or cube, equal to the last bit over any partitioning."""
    total, n = (F.sum("dist_sum"), F.sum("dist_n")) if is_cube(df) else (F.sum(exact_distance()), F.count(DISTANCE))
    return F.when(n > 0, total.cast("double") / (n * F.lit(DISTANCE_STEPS)))


def length_unit(df: DataFrame) -> str:
    """Unit in which the lengths of rides or cube are shown."""
    return unit_of(df, "len_max" if is_cube(df) else LENGTH)


def short_count(df: DataFrame, short_seconds: float = 60, length_col: str = LENGTH) -> Column:
    """Rides shorter than ``short_seconds``. A cube answers only for the
    threshold it was built with; another one fails the query."""
    if not is_cube(df):
        return F.count_if(F.col(length_col) < short_seconds)
    _only_length(length_col)
    wrong = F.raise_error(F.format_string("the ride cube counts rides under %s s, not " + str(float(short_seconds)), F.col("short_seconds")))
    return F.sum(F.when(F.col("short_seconds") == float(short_seconds), F.col("n_short")).otherwise(wrong.cast("bigint")))


# ---------------------------------------------------------------- stations
#
# The station rankings all count rides per (start or end station, rider
# type). ``station_table`` computes both sides in one scan with grouping
# sets (each ride feeds both sets inside the task; only the per-task partial
# counts are shuffled): columns side ('start'/'end'), station, member_casual,
# n. The ranking functions accept it in place of the rides.

STATION_TABLE_COLUMNS = ["side", "station", "member_casual", "n"]


def station_table(cleaned: DataFrame) -> DataFrame:
    g = cleaned.groupingSets(
        [["start_station_name", "member_casual"], ["end_station_name", "member_casual"]],
        "start_station_name",
        "end_station_name",
        "member_casual",
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping("end_station_name").alias("__start_set"))
    start = F.col("__start_set") == 1
    return g.select(
        F.when(start, F.lit("start")).otherwise(F.lit("end")).alias("side"),
        F.when(start, F.col("start_station_name")).otherwise(F.col("end_station_name")).alias("station"),
        "member_casual",
        "n",
    )


def is_station_table(df: DataFrame) -> bool:
    return df.columns == STATION_TABLE_COLUMNS


def _with_calendar(cube: DataFrame) -> DataFrame:
    return cube.withColumns(
        {
            "is_weekend": C.is_weekend("day_of_week"),
            "month_num": C.month_num("month_start"),
            "month_label": C.month_label("month_start"),
            "month_name": C.month_name("month_start"),
        }
    )


def summary_tables(cleaned: DataFrame, short_seconds: float = 60) -> DataFrame:
    """``ride_cube`` and ``station_table`` from one scan: a grouping-sets
    aggregate over the cube keys, (start station, rider type) and (end station,
    rider type). Split it with ``cube_of`` and ``stations_of``; cache or write
    it first so the rides are read once."""
    return cleaned.groupingSets(
        [CUBE_KEYS, ["start_station_name", "member_casual"], ["end_station_name", "member_casual"]],
        *CUBE_KEYS,
        "start_station_name",
        "end_station_name",
    ).agg(
        *_measures(cleaned, short_seconds),
        F.grouping("rideable_type").alias("__not_cube"),
        F.grouping("start_station_name").alias("__not_start"),
    )


def cube_of(tables: DataFrame) -> DataFrame:
    """The ``ride_cube`` part of ``summary_tables`` (same columns)."""
    return _with_calendar(tables.filter(F.col("__not_cube") == 0).select(*CUBE_KEYS, *CUBE_MEASURES))


def stations_of(tables: DataFrame) -> DataFrame:
    """The ``station_table`` part of ``summary_tables`` (same columns)."""
    start = F.col("__not_start") == 0
    return tables.filter(F.col("__not_cube") == 1).select(
        F.when(start, F.lit("start")).otherwise(F.lit("end")).alias("side"),
        F.when(start, F.col("start_station_name")).otherwise(F.col("end_station_name")).alias("station"),
        "member_casual",
        "n",
    )
