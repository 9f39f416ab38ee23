"""The statistics behind the reference's charts, as bounded tables.

No raw rides are collected for drawing: each chart becomes an aggregate
(bins, quartiles, stacked positions) computed on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.text import percent_decimals, percent_label
from cadence.operators.cube import count_of
from cadence.operators.joins import broadcast_if_small
from cadence.operators.lengths import exact_quantiles, lengths_of
from cadence.sources.store import materialize


def histogram_bin(x: Column, binwidth: float = 5.0, center: float = 0.0) -> Column:
    """Centre of the right-closed bin holding ``x``; bins are centred on
    ``center + k * binwidth``: (c - w/2, c + w/2]."""
    w = F.lit(float(binwidth))
    lower = F.lit(float(center) + float(binwidth) / 2.0)
    return F.ceil((x - lower) / w) * w + F.lit(float(center))


def ride_length_histogram(rides: DataFrame, binwidth: float = 5.0, center: float = 0.0, unit_seconds: float = 60.0) -> DataFrame:
    """Counts per length bin (minutes) and rider type, from the rides or
    their ``length_table``. Rides without a length fall in the null bin."""
    table = rides.columns == ["member_casual", "ride_length", "n"]
    x = F.col("ride_length") / F.lit(float(unit_seconds))
    return rides.groupBy(histogram_bin(x, binwidth, center).cast("double").alias("bin_center"), "member_casual").agg(
        (F.sum("n") if table else F.count(F.lit(1))).alias("count")
    )


def rides_by_day_counts(rides: DataFrame) -> DataFrame:
    """Bar heights of the dodged day chart: raw rides per weekday x rider."""
    return rides.groupBy("day_of_week", "member_casual").agg(count_of(rides).alias("count"))


def quartiles(rides: DataFrame, group: str = "member_casual", seconds_col: str = "ride_length") -> DataFrame:
    """Exact quartiles per group (linear interpolation) from the rides or
    their ``length_table``: one row per group."""
    q = exact_quantiles(lengths_of(rides, group, seconds_col), [0.25, 0.5, 0.75], group, seconds_col)
    return q.select(group, F.col("q0").alias("__q1"), F.col("q1").alias("__med"), F.col("q2").alias("__q3"))


def _with_quartiles(df: DataFrame, stats: DataFrame | None, group: str, seconds_col: str) -> DataFrame:
    # ``stats`` as kept by the caller, or computed and written now
    if stats is None:
        stats = materialize(quartiles(df, group, seconds_col), "boxplot_quartiles")
    q = broadcast_if_small(stats).withColumnRenamed(group, "__g")
    return df.join(q, F.col(group).eqNullSafe(F.col("__g")), "inner").drop("__g")


def _fences() -> tuple[Column, Column]:
    iqr = F.col("__q3") - F.col("__q1")
    return F.col("__q1") - F.lit(1.5) * iqr, F.col("__q3") + F.lit(1.5) * iqr


def ride_length_boxplot(
    rides: DataFrame, group: str = "member_casual", seconds_col: str = "ride_length", unit_seconds: float = 60.0, stats: DataFrame | None = None
) -> DataFrame:
    """Box-plot figures per group: quartiles (linear interpolation), whiskers
    at the most extreme values within 1.5 x IQR of the box, and the number of
    values beyond them. Reported in minutes by default.

    Works on the ``length_table`` (built here if rides are given); ``stats``
    are its ``quartiles`` if the caller keeps them. Quartiles are taken on
    seconds and scaled afterwards, so no rounding differs between passes.
    """
    lo_fence, hi_fence = _fences()
    x = F.col(seconds_col)
    joined = _with_quartiles(lengths_of(rides, group, seconds_col), stats, group, seconds_col)
    agg = joined.groupBy(group, "__q1", "__med", "__q3").agg(
        F.min(F.when(x >= lo_fence, x)).alias("__lo"),
        F.max(F.when(x <= hi_fence, x)).alias("__hi"),
        F.sum(F.when((x < lo_fence) | (x > hi_fence), F.col("n")).otherwise(0)).alias("outliers"),
    )
    u = F.lit(float(unit_seconds))
    return agg.select(
        group,
        (F.col("__lo") / u).alias("lower_whisker"),
        (F.col("__q1") / u).alias("q1"),
        (F.col("__med") / u).alias("median"),
        (F.col("__q3") / u).alias("q3"),
        (F.col("__hi") / u).alias("upper_whisker"),
        "outliers",
    )


def ride_length_outliers(
    rides: DataFrame, group: str = "member_casual", seconds_col: str = "ride_length", stats: DataFrame | None = None
) -> DataFrame:
    """The box plot's outlier points: rides beyond 1.5 x IQR of their group's
    box (a filter view over the rides, behind a broadcast of the quartiles)."""
    lo_fence, hi_fence = _fences()
    x = F.col(seconds_col)
    joined = _with_quartiles(rides, stats, group, seconds_col)
    return joined.filter((x < lo_fence) | (x > hi_fence)).select(*rides.columns)


def stack_positions(df: DataFrame, x: list[str], category: str, value: str) -> DataFrame:
    """Stacked-bar positions: the first category is drawn on top, so the
    running total accumulates from the last category. Adds ``ymin``, ``ymax``
    and the label midpoint ``ymid`` (same unit as ``value``).

    ``df`` is an aggregate (one row per x and category); the window partitions
    by ``x`` only.
    """
    w = Window.partitionBy(*x).orderBy(F.col(category).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ymax = F.sum(value).over(w)
    return df.withColumn("ymax", ymax).withColumn("ymin", F.col("ymax") - F.col(value)).withColumn(
        "ymid", F.col("ymax") - F.col(value) / F.lit(2.0)
    )


def ride_share_positions(share: DataFrame) -> DataFrame:
    """Pie-chart positions for ``ride_share_by_member_type``, in rides and as a
    fraction of all rides (fractions = integer positions / total, so they do
    not depend on summation order). Labels have as many decimals as tell the
    shares apart."""
    pos = stack_positions(share, [], "member_casual", "total_rides")
    total = F.sum("total_rides").over(Window.partitionBy())
    return pos.select(
        "member_casual",
        "total_rides",
        "ymax",
        "ymid",
        (F.col("ymax") / total).alias("ymax_share"),
        (F.col("ymid") / total).alias("ymid_share"),
        percent_label("proportion", percent_decimals(F.collect_set("proportion").over(Window.partitionBy()))).alias("label"),
    )


def distance_vs_length(rides: DataFrame) -> DataFrame:
    """Scatter-plot points: every ride's distance, length in minutes, rider."""
    return rides.select("trip_distance", "ride_length_min", "member_casual")


def distance_length_bins(rides: DataFrame, distance_step: float = 0.05, minutes_step: float = 5.0) -> DataFrame:
    """Scatter plot at scale: counts on a 2-D grid of (distance, minutes)
    cells per rider type; each cell is named by its lower edges."""
    # cells are counted by their whole numbers; edges are computed for the few cells
    cells = rides.groupBy(
        F.floor(F.col("trip_distance") / F.lit(distance_step)).alias("d"), F.floor(F.col("ride_length_min") / F.lit(minutes_step)).alias("m"), "member_casual"
    ).agg(F.count(F.lit(1)).alias("count"))
    return cells.select(
        (F.col("d") * F.lit(float(distance_step))).alias("distance_bin"), (F.col("m") * F.lit(float(minutes_step))).alias("minutes_bin"), "member_casual", "count"
    )


def rides_by_start_location(rides: DataFrame) -> DataFrame:
    """Bubble-map data: rides per start coordinate and rider type."""
    return rides.groupBy("start_lng", "start_lat", "member_casual").agg(F.count(F.lit(1)).alias("number_of_rides"))
