"""Exact order statistics of ride lengths from one table of distinct lengths.

``length_table`` folds the rides to one row per (rider type, length) with a
count: the key is the length itself, so a rider type that holds most rides is
spread over all reducers. Median, quartiles, whiskers, outlier counts and the
histogram all come from it. Quantiles are found by rank in two steps: running
counts over one-second bins (as many per group as the longest ride has
seconds), then running counts inside the few bins that hold a wanted rank. No
task collects the lengths of a whole group, and nothing is approximated.

Null lengths do not count; a null group is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.cube import LENGTH, exact_seconds

GROUP = "member_casual"


def length_table(rides: DataFrame, group: str = GROUP, value: str = LENGTH) -> DataFrame:
    """Columns ``group``, ``value``, ``n``."""
    return rides.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))


def lengths_of(df: DataFrame, group: str = GROUP, value: str = LENGTH) -> DataFrame:
    """``df`` itself if it is a length table, otherwise the one of its rides."""
    return df if df.columns == [group, value, "n"] else length_table(df, group, value)


def mean_of_lengths(value: str = LENGTH) -> Column:
    total = F.sum(exact_seconds(value) * F.col("n"))
    return total.cast("double") / F.sum("n")


def exact_quantiles(lengths: DataFrame, probs: list[float], group: str = GROUP, value: str = LENGTH) -> DataFrame:
    """One row per group with ``q0``, ``q1``, ... for ``probs`` (linear
    interpolation between the neighbouring ranks)."""
    table = lengths.withColumn("__bin", F.floor(value))
    running = Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = (
        table.groupBy(group, "__bin")
        .agg(F.sum("n").alias("__n"))
        .select(
            group,
            "__bin",
            (F.sum("__n").over(running) - F.col("__n")).alias("__before"),
            "__n",
            F.sum("__n").over(Window.partitionBy(group)).alias("__total"),
        )
    )
    places = [F.lit(float(p)) * (F.col("__total") - 1) for p in probs]
    ranks = [rank for p in places for rank in (F.floor(p), F.ceil(p))]

    def holds(rank: Column, before: Column, n: Column) -> Column:
        return (rank >= before) & (rank < before + n)

    hit = F.lit(False)
    for rank in ranks:
        hit = hit | holds(rank, F.col("__before"), F.col("__n"))
    wanted = bins.filter(hit).select(F.col(group).alias("__g"), F.col("__bin").alias("__b"), "__before", "__total")
    inside = Window.partitionBy(group, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = table.join(wanted, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bin") == F.col("__b")))
    near = near.withColumn("__first", F.col("__before") + F.sum("n").over(inside) - F.col("n"))
    at = [F.max(F.when(holds(rank, F.col("__first"), F.col("n")), F.col(value))).alias(f"__r{i}") for i, rank in enumerate(ranks)]
    found = near.groupBy(group).agg(F.max("__total").alias("__total"), *at)
    out = []
    for i, place in enumerate(places):
        lo, hi = F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}")
        between = (F.ceil(place) - place) * lo + (place - F.floor(place)) * hi
        out.append(F.when(lo == hi, lo).otherwise(between).alias(f"q{i}"))
    return found.select(group, *out)
