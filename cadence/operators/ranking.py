"""Station rankings, top-k with and without ties, display order.

Ranks are always taken on aggregated counts (one row per station), never on
raw rides. Every function taking ``rides`` also accepts the pre-aggregated
``cube.station_table`` (both station sides counted in one scan). Ties are kept by a
cut value (see ``top_with_ties``); ``row_number() <= k`` filters get a partial
``WindowGroupLimit`` before the shuffle, so each task forwards at most k rows per
group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.cube import is_station_table


def sort_by(df: DataFrame, *specs: str | Column) -> DataFrame:
    """Sort with nulls last in both directions. Plain names sort ascending;
    pass ``F.desc('x')`` (or ``'-x'``) for descending."""
    cols = []
    for s in specs:
        if isinstance(s, str) and s.startswith("-"):
            cols.append(F.col(s[1:]).desc_nulls_last())
        elif isinstance(s, str):
            cols.append(F.col(s).asc_nulls_last())
        else:
            cols.append(s)
    return df.orderBy(*cols)


def _station_counts(rides: DataFrame, station_col: str, by_member: bool, count_name: str) -> DataFrame:
    """Rides per station (and rider type), from the rides or from the
    pre-aggregated ``station_table``."""
    keys = ["member_casual", station_col] if by_member else [station_col]
    if is_station_table(rides):
        side = "start" if station_col.startswith("start") else "end"
        t = rides.filter(F.col("side") == side).withColumnRenamed("station", station_col)
        return t.groupBy(*keys).agg(F.sum("n").alias(count_name))
    return rides.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))


def popular_stations(rides: DataFrame, station_col: str) -> DataFrame:
    """Rides per station, busiest first (a null-name group is kept)."""
    return sort_by(_station_counts(rides, station_col, False, "ride_count"), "-ride_count", station_col)


def popular_start_stations(rides: DataFrame) -> DataFrame:
    return popular_stations(rides, "start_station_name")


def popular_end_stations(rides: DataFrame) -> DataFrame:
    return popular_stations(rides, "end_station_name")


def popular_stations_by_member(rides: DataFrame, station_col: str) -> DataFrame:
    return sort_by(_station_counts(rides, station_col, True, "ride_count"), "member_casual", "-ride_count", station_col)


def popular_start_stations_by_member(rides: DataFrame) -> DataFrame:
    return popular_stations_by_member(rides, "start_station_name")


def popular_end_stations_by_member(rides: DataFrame) -> DataFrame:
    return popular_stations_by_member(rides, "end_station_name")


def top_with_ties(df: DataFrame, n: int, by: str, partition: list[str] | None = None) -> DataFrame:
    """Rows whose ``by`` value is among the ``n`` largest, ties kept (so the
    result can exceed ``n`` rows), globally or per ``partition`` group.

    The ``n``-th largest value is found first, from ``n`` rows a task (and group);
    rows are kept by comparing with it, where they are. However many rows tie, none
    are sorted or gathered for their rank.
    """
    if not partition:
        least = df.select(F.col(by).alias("__cut")).orderBy(F.desc("__cut")).limit(n).agg(F.min("__cut").alias("__cut"))
        return df.filter(F.col(by) >= least.scalar())
    keys = [f"__k{i}" for i in range(len(partition))]
    first = head_per_group(df.select(*[F.col(p).alias(k) for p, k in zip(partition, keys)], F.col(by).alias("__cut")), n, keys, [F.desc("__cut")])
    cuts = first.groupBy(*keys).agg(F.min("__cut").alias("__cut"))
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(k)) for p, k in zip(partition, keys)])
    return df.join(cuts, same & (F.col(by) >= F.col("__cut")), "left_semi")


def head_per_group(df: DataFrame, n: int, partition: list[str], order: list[Column]) -> DataFrame:
    """First ``n`` rows of each group in the given order (no ties)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def top_start_stations(rides: DataFrame, n: int = 10) -> DataFrame:
    counts = _station_counts(rides, "start_station_name", False, "ride_count")
    return sort_by(top_with_ties(counts, n, "ride_count"), "-ride_count", "start_station_name")


def top_end_stations(rides: DataFrame, n: int = 10) -> DataFrame:
    counts = _station_counts(rides, "end_station_name", False, "ride_count")
    return sort_by(top_with_ties(counts, n, "ride_count"), "-ride_count", "end_station_name")


def top_start_stations_by_member(rides: DataFrame, n: int = 10) -> DataFrame:
    counts = _station_counts(rides, "start_station_name", True, "ride_count")
    return sort_by(top_with_ties(counts, n, "ride_count", ["member_casual"]), "member_casual", "-ride_count", "start_station_name")


def top_end_stations_by_member(rides: DataFrame, n: int = 10) -> DataFrame:
    counts = _station_counts(rides, "end_station_name", True, "ride_count")
    return sort_by(top_with_ties(counts, n, "ride_count", ["member_casual"]), "member_casual", "-ride_count", "end_station_name")


def station_by_member_head(rides: DataFrame, station_col: str, count_name: str, n: int = 10) -> DataFrame:
    """Per (station, rider type) counts, then the first ``n`` rows *per
    station* (the grouping left over after summarising by two keys). Each
    station has one row per rider type, so nothing is cut for n >= 2."""
    counts = _station_counts(rides, station_col, True, count_name).select(station_col, "member_casual", count_name)
    kept = head_per_group(counts, n, [station_col], [F.col(count_name).desc(), F.col("member_casual").asc_nulls_last()])
    return sort_by(kept, f"-{count_name}", station_col, "member_casual")


def station_starts_by_member(rides: DataFrame, n: int = 10) -> DataFrame:
    return station_by_member_head(rides, "start_station_name", "number_of_starts", n)


def station_ends_by_member(rides: DataFrame, n: int = 10) -> DataFrame:
    return station_by_member_head(rides, "end_station_name", "number_of_ends", n)


def top_utilized_stations(utilization: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows of the utilisation table (no ties): an ordered limit,
    planned as a per-task top-n and a final merge of n rows per task."""
    return utilization.orderBy(F.col("station_rides").desc(), F.col("start_station_name").asc_nulls_last()).limit(n)


def first_row(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """The value of ``column`` in the first row of ``df`` sorted by ``order``."""
    return df.orderBy(*order).limit(1).select(column)


def display_order(df: DataFrame, label: str, value: str) -> DataFrame:
    """Order of ``label`` values by the mean of ``value`` per label (a label
    that appears in several panels averages them), ties by label text.

    Meant for chart-sized tables (top-k results): the position is a global
    row number over the distinct labels.
    """
    means = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.avg(value).alias("order_value"))
    w = Window.orderBy(F.col("order_value").asc(), F.col(label).asc())
    return means.withColumn("position", F.row_number().over(w))
