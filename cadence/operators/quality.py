"""Scalar aggregates and data-quality reports.

Each returns a one-row (or few-row) DataFrame; the caller decides whether to
collect it. All are single-pass global aggregates (partial per task, one
final merge of a handful of values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.columns import day_label
from cadence.functions.text import r_format_digits, report_line
from cadence.operators.cube import count_of, is_cube, length_unit, max_length, mean_length
from cadence.operators.elapsed import UNITS
from cadence.schema import RIDE_COLUMNS


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def cleaned_row_count(complete: DataFrame) -> DataFrame:
    """Rides left after dropping incomplete rows."""
    return row_count(complete, "cleaned_row_count")


def filtered_row_count(cleaned: DataFrame) -> DataFrame:
    """Rides left after the length filters."""
    return row_count(cleaned, "filtered_row_count")


def null_count(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias(name or f"na_{column}_count"))


def na_start_station_name_count(complete: DataFrame) -> DataFrame:
    return null_count(complete, "start_station_name", "na_start_station_name_count")


def na_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count of every column, as one wide row named like the columns."""
    cols = columns or [c for c in df.columns if c in RIDE_COLUMNS] or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def mean_ride_length(cleaned: DataFrame) -> DataFrame:
    """Mean length (rides or ``ride_cube``)."""
    return cleaned.agg(mean_length(cleaned).alias("mean_ride_length"))


def max_ride_length(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(max_length(cleaned).alias("max_ride_length"))


def mode_day_of_week_index(cleaned: DataFrame) -> DataFrame:
    """Most frequent weekday as its 1-based Sunday-first index; ties go to the
    earlier day. Seven groups: the ordered limit is trivial."""
    counts = cleaned.groupBy("day_of_week_num").agg(count_of(cleaned).alias("__n"))
    return (
        counts.orderBy(F.col("__n").desc(), F.col("day_of_week_num").asc_nulls_last())
        .limit(1)
        .select(F.col("day_of_week_num").alias("mode_day_of_week_index"))
    )


def mode_day_of_week(cleaned: DataFrame) -> DataFrame:
    return mode_day_of_week_index(cleaned).select(day_label("mode_day_of_week_index").alias("mode_day_of_week"))


def day_label_from_index(cleaned: DataFrame) -> DataFrame:
    """The mode's factor index turned into its label (``levels(f)[i]``)."""
    idx = mode_day_of_week_index(cleaned)
    return idx.select("mode_day_of_week_index", day_label("mode_day_of_week_index").alias("mode_day_of_week"))


def summary_statistics(cleaned: DataFrame, digits: int = 2) -> DataFrame:
    """Three-row (metric, value) table: mean and max length as text with at
    least ``digits`` significant digits and their unit (see ``elapsed``), and the
    mode weekday."""
    unit = length_unit(cleaned)
    shown = lambda c: F.concat(r_format_digits(F.col(c) / F.lit(float(UNITS[unit])), digits), F.lit(f" {unit}"))
    # one pass: mean, max and the weekday mode (on rides the deterministic
    # mode takes the lowest index among ties = earliest day, Sunday first)
    row = _length_stats(cleaned).select(
        F.col("mean").alias("m"), F.col("max").alias("x"), F.col("mode").alias("mode_day_of_week")
    )
    return row.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("i"), F.lit("Mean Ride Length").alias("metric"), shown("m").alias("value")),
                F.struct(F.lit(2).alias("i"), F.lit("Max Ride Length").alias("metric"), shown("x").alias("value")),
                F.struct(F.lit(3).alias("i"), F.lit("Mode Day of the Week").alias("metric"), F.col("mode_day_of_week").alias("value")),
            )
        )
    ).orderBy("i").drop("i")


def cleaned_row_report(complete: DataFrame) -> DataFrame:
    """One printed line: 'Number of rows remaining after cleaning: N'."""
    return cleaned_row_count(complete).select(
        report_line("Number of rows remaining after cleaning:", "cleaned_row_count").alias("line")
    )


def _length_stats(cleaned: DataFrame) -> DataFrame:
    """One row: ride count, mean and max length, and the weekday mode (ties
    to the earlier day), from the rides or from the ``ride_cube``."""
    if is_cube(cleaned):
        days = cleaned.groupBy("day_of_week_num").agg(
            F.sum("n").alias("n"), F.sum("len_sum").alias("s"), F.max("len_max").alias("mx")
        )
        return days.agg(
            F.sum("n").alias("n"),
            (F.sum("s").cast("double") / F.sum("n")).alias("mean"),
            F.max("mx").alias("max"),
            day_label(F.max_by("day_of_week_num", F.struct(F.col("n"), -F.col("day_of_week_num")))).alias("mode"),
        )
    return cleaned.agg(
        F.count(F.lit(1)).alias("n"),
        mean_length(cleaned).alias("mean"),
        F.max("ride_length").alias("max"),
        day_label(F.mode("day_of_week_num", True)).alias("mode"),
    )


def report_lines(complete: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The six printed progress lines of a run, numbered in print order:
    rows after cleaning, null start names, rows after filtering, mean, max
    and mode. One scan of the complete rides for the first two; the rest
    from the cleaned rides or the ``ride_cube``. Lengths with six decimals."""
    a = complete.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start_station_name").isNull()).alias("na"))
    b = _length_stats(cleaned)

    def line(i: int, label: str, value) -> F.Column:
        return F.struct(F.lit(i).alias("line_no"), report_line(label, value).alias("line"))

    fixed = lambda c: F.format_string("%.6f", F.col(c))
    first = a.select(
        F.inline(
            F.array(
                line(1, "Number of rows remaining after cleaning:", "n"),
                line(2, "Number of NA values in start_station_name:", "na"),
            )
        )
    )
    second = b.select(
        F.inline(
            F.array(
                line(3, "Number of rows remaining after filtering:", "n"),
                line(4, "Mean ride length:", fixed("mean")),
                line(5, "Max ride length:", fixed("max")),
                line(6, "Mode day of the week:", "mode"),
            )
        )
    )
    return first.unionByName(second)
