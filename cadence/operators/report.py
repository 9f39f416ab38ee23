"""Printed outputs of the reference as bounded DataFrames: a preview of a
table, the final recap of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators import quality as Q
from cadence.operators.cube import count_of, max_length, mean_length, short_count


def preview(df: DataFrame, n: int = 6, order_by: tuple[str, ...] = ("started_at", "ride_id")) -> DataFrame:
    """First ``n`` rows in a fixed order (``head``/``print``): an ordered
    limit, planned as a per-task top-n; never collects the table."""
    return df.orderBy(*order_by).limit(n)


def _fixed(col: Column, decimals: int = 6) -> Column:
    return F.format_string(f"%.{decimals}f", col)


def _entry(section: str, key: Column, value: Column, keep: Column) -> Column:
    return F.when(keep, F.struct(F.lit(section).alias("section"), key.alias("key"), value.alias("value")))


def analysis_summary(cleaned: DataFrame, short_seconds: float = 60) -> DataFrame:
    """The closing recap as a long (section, key, value) table: mean and max
    length, the mode weekday, the rider-type shares, short rides per rider
    type and rides per rider x bike type.

    One rollup over (rider type, bike type) carries counts, short-ride
    counts, length sums and maxima at three levels (pair, rider type, all);
    each of its rows emits its recap lines. With the weekday counts for the
    mode that is two scans of the rides, or of the small ``ride_cube``.
    """
    levels = cleaned.rollup("member_casual", "rideable_type").agg(
        count_of(cleaned).alias("n"),
        short_count(cleaned, short_seconds).alias("n_short"),
        mean_length(cleaned).alias("len_mean"),
        max_length(cleaned).alias("len_max"),
        F.grouping_id().alias("level"),  # 0 pair, 1 rider type, 3 all rides
    )
    # all-rides count beside every level row (a window over the few rollup rows)
    levels = levels.withColumn("__total", F.max(F.when(F.col("level") == 3, F.col("n"))).over(Window.partitionBy()))
    n, level, total = F.col("n"), F.col("level"), F.col("__total")
    blank = F.lit("")
    entries = F.array(
        _entry("Mean ride length", blank, _fixed(F.col("len_mean")), level == 3),
        _entry("Max ride length", blank, _fixed(F.col("len_max")), level == 3),
        _entry(
            "Proportional Share of Rides by Member Type",
            F.col("member_casual"),
            F.concat(n.cast("string"), F.lit(" rides, "), _fixed(n / total)),
            level == 1,
        ),
        _entry("Number of Short Rides by Member Type", F.col("member_casual"), F.col("n_short").cast("string"), (level == 1) & (F.col("n_short") > 0)),
        _entry(
            "Number of Rides by Rideable Type and Member Type",
            F.concat_ws(" / ", "member_casual", "rideable_type"),
            n.cast("string"),
            level == 0,
        ),
    )
    lines = levels.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))
    mode = Q.mode_day_of_week(cleaned).select(
        F.lit("Mode day of the week").alias("section"), blank.alias("key"), F.col("mode_day_of_week").alias("value")
    )
    return lines.unionByName(mode)
