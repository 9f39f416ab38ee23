"""Named queries: one entry per operator / result table of the reference.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the generated tables in
``sf_dir`` (rides come from ``events`` through the adapter). The cleaning
stages are prepared once per application and input (see ``prepare``), so
every summary reads the materialised complete-ride table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import chartdata as CH
from cadence.operators import clean as K
from cadence.operators import quality as Q
from cadence.operators import ranking as R
from cadence.operators import report as RP
from cadence.operators import summaries as S
from cadence.operators import features as FT
from cadence.operators.features import FEATURE_COLUMNS
from cadence.plans.prepare import PreparedRides, input_version, prepared, spread_if_few_partitions
from cadence.schema import RIDE_COLUMNS
from cadence.sources import csv as CSV
from cadence.sources.events import load_rides
from cadence.sources.store import table_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        _QUERIES[name] = fn
        return fn

    return deco


def on_cleaned(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark, sf_dir).cleaned)


CUBE_QUERIES: set[str] = set()
STATION_QUERIES: set[str] = set()


def on_cube(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Summaries over calendar / category keys, computed from the prepared
    ride cube (one scan of the rides for all of them)."""
    CUBE_QUERIES.add(name)
    _QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark, sf_dir).cube)


def on_stations(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Station rankings, computed from the prepared station table (one scan
    of the rides for all of them)."""
    STATION_QUERIES.add(name)
    _QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark, sf_dir).stations)


def on_lengths(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Length statistics, computed from the prepared table of distinct lengths."""
    _QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark, sf_dir).lengths)


def on_names(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark, sf_dir).names)


def _p(spark: SparkSession, sf_dir: str) -> PreparedRides:
    return prepared(spark, sf_dir)


_ALL = RIDE_COLUMNS + FEATURE_COLUMNS

# ------------------------------------------------------------ sources / sinks

_CSV_CACHE: dict[tuple, str] = {}


def _rides_csv(spark: SparkSession, sf_dir: str, monthly: bool) -> str:
    """Write the adapter rides once as CSV (one folder per start month when
    ``monthly``) under the shared folder; return the base path."""
    base = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, base, input_version(spark, f"{base}/events.parquet"), monthly)
    if key not in _CSV_CACHE:
        path = table_path(spark, "rides_csv_monthly" if monthly else "rides_csv")
        rides = spread_if_few_partitions(load_rides(spark, sf_dir))
        if monthly:
            rides = rides.withColumn("month", F.date_format("started_at", "yyyy-MM"))
        CSV.write_rides_csv(rides, path, ["month"] if monthly else None)
        _CSV_CACHE[key] = path
    return _CSV_CACHE[key]


@query("read_rides_csv")
def q_read_rides_csv(spark, sf_dir):
    return CSV.read_rides_csv(spark, _rides_csv(spark, sf_dir, False))


@query("combine_ride_files")
def q_combine_ride_files(spark, sf_dir):
    return CSV.combine_ride_files([f"{_rides_csv(spark, sf_dir, True)}/month=*"], spark)


@query("ingest_ride_files")
def q_ingest_ride_files(spark, sf_dir):
    """Streaming form of combining monthly files: every monthly CSV folder is
    ingested once by a file-source stream into an append-only table."""
    from cadence.streaming import ingest_ride_files

    return ingest_ride_files(spark, f"{_rides_csv(spark, sf_dir, True)}/month=*")


_EXPORT_SCHEMAS = {
    "average_ride_length_by_member": "member_casual string, average_ride_length double",
    "average_ride_length_by_day": "day_of_week string, member_casual string, average_ride_length double",
    "rides_by_day": "day_of_week string, member_casual string, number_of_rides bigint",
}


@query("write_summary_csv")
def q_write_summary_csv(spark, sf_dir):
    cube = _p(spark, sf_dir).cube
    base = table_path(spark, "exports")
    parts = {
        "average_ride_length_by_member": S.average_ride_length_by_member(cube),
        "average_ride_length_by_day": S.average_ride_length_by_day(cube),
        "rides_by_day": S.rides_by_day(cube),
    }
    frames = []
    for name, df in parts.items():
        CSV.write_summary_csv(df, f"{base}/{name}.csv")
        back = CSV.read_summary_csv(spark, f"{base}/{name}.csv", _EXPORT_SCHEMAS[name])
        value = back.columns[-1]
        day = F.col("day_of_week") if "day_of_week" in back.columns else F.lit(None).cast("string")
        frames.append(
            back.select(F.lit(name).alias("export"), day.alias("day_of_week"), "member_casual", F.col(value).cast("double").alias("value"))
        )
    return reduce(DataFrame.unionByName, frames)


@query("preview")
def q_preview(spark, sf_dir):
    return RP.preview(K.zero_or_negative_rides(_p(spark, sf_dir).complete), 6).select(*_ALL)


@query("report_line")
def q_report_line(spark, sf_dir):
    return Q.cleaned_row_report(_p(spark, sf_dir).complete)


@query("report_lines")
def q_report_lines(spark, sf_dir):
    p = _p(spark, sf_dir)
    return Q.report_lines(p.complete, p.cube)


@query("analysis_summary")
def q_analysis_summary(spark, sf_dir):
    return RP.analysis_summary(_p(spark, sf_dir).cube)


# ------------------------------------------------ projections and filters


@query("select_columns")
def q_select_columns(spark, sf_dir):
    return _p(spark, sf_dir).matched_rides().select(*K.ROUTE_KEYS)


@query("drop_column")
def q_drop_column(spark, sf_dir):
    return FT.drop_column(_p(spark, sf_dir).complete.select(*_ALL), "ride_length_min")


on_cleaned("with_column", lambda c: FT.with_column(c.drop("ride_length_min"), "ride_length_min", "ride_length / 60D").select(*_ALL))


@query("cleaned_rides_recorded_session")
def q_cleaned_rides_recorded_session(spark, sf_dir):
    """The recorded console session fills end names only (no start fill)."""
    return prepared(spark, sf_dir, fill_start=False).cleaned.select(*RIDE_COLUMNS, "ride_length")


@query("drop_incomplete_rides")
def q_drop_incomplete(spark, sf_dir):
    return K.drop_incomplete_rides(_p(spark, sf_dir).filled())


@query("zero_or_negative_rides")
def q_zero_or_negative(spark, sf_dir):
    return K.zero_or_negative_rides(_p(spark, sf_dir).complete).select(*_ALL)


@query("drop_nonpositive_rides")
def q_drop_nonpositive(spark, sf_dir):
    return K.drop_nonpositive_rides(_p(spark, sf_dir).complete).select(*_ALL)


@query("drop_too_short_rides")
def q_drop_too_short(spark, sf_dir):
    return K.drop_too_short_rides(K.drop_nonpositive_rides(_p(spark, sf_dir).complete)).select(*_ALL)


on_cleaned("short_rides", lambda c: K.short_rides(c).select(*_ALL))
on_cleaned("casual_rides", lambda c: K.casual_rides(c).select(*_ALL))
on_cleaned("having", lambda c: S.having(c, ["ride_id"], "number_of_rides", 1))


@query("grouped_filter")
def q_grouped_filter(spark, sf_dir):
    return K.grouped_filter(_p(spark, sf_dir).matching, ["end_station_id"])



@query("is_in_column")
def q_is_in_column(spark, sf_dir):
    return _p(spark, sf_dir).matched_rides()


on_cleaned(
    "is_in_list",
    lambda c: c.filter(F.col("day_of_week").isin("Saturday", "Sunday")).select("ride_id", "started_at", "day_of_week", "is_weekend"),
)

# ----------------------------------------------------------- derived columns


def _on_complete(name: str, cols: list[str]) -> None:
    add = getattr(FT, name)
    _QUERIES[name] = lambda spark, sf_dir: add(_p(spark, sf_dir).complete.select(*RIDE_COLUMNS)).select(*cols)


_BASE = ["ride_id", "started_at", "ended_at"]
_on_complete("add_ride_length", _BASE + ["ride_length"])
_on_complete("add_ride_length_minutes", _BASE + ["ride_length_min"])
_on_complete("add_day_of_week", _BASE + ["day_of_week_num", "day_of_week"])
_on_complete("add_hour_of_day", _BASE + ["hour_of_day"])
_on_complete("add_is_weekend", _BASE + ["is_weekend"])
_on_complete("add_month_label", _BASE + ["month_num", "month_label"])
_on_complete("add_month_start", _BASE + ["month_start"])
_on_complete("add_month_name", _BASE + ["month_name"])
_on_complete("add_trip_distance", ["ride_id", "start_lat", "start_lng", "end_lat", "end_lng", "trip_distance"])

# ------------------------------------------------------------ joins, lookups



@query("matching_station_ids")
def q_matching_station_ids(spark, sf_dir):
    return _p(spark, sf_dir).matching



@query("fill_end_station_name")
def q_fill_end(spark, sf_dir):
    return _p(spark, sf_dir).filled_end()


@query("fill_start_station_name")
def q_fill_start(spark, sf_dir):
    return _p(spark, sf_dir).filled()


on_names("end_station_lookup", K.end_station_lookup)
on_names("start_station_lookup", K.start_station_lookup)
on_names("end_station_lookup_conflicts", K.end_station_lookup_conflicts)
on_names("start_station_lookup_conflicts", K.start_station_lookup_conflicts)


@query("end_station_lookup_clean")
def q_end_lookup_clean(spark, sf_dir):
    return _p(spark, sf_dir).end_lookup


@query("start_station_lookup_clean")
def q_start_lookup_clean(spark, sf_dir):
    return _p(spark, sf_dir).start_lookup


@query("distinct_rows")
def q_distinct_rows(spark, sf_dir):
    return _p(spark, sf_dir).raw.select("start_station_id", "start_station_name").distinct()


# ------------------------------------------------------- scalars, quality


@query("cleaned_row_count")
def q_cleaned_row_count(spark, sf_dir):
    return Q.cleaned_row_count(_p(spark, sf_dir).complete)


on_cleaned("filtered_row_count", Q.filtered_row_count)


@query("na_start_station_name_count")
def q_na_start(spark, sf_dir):
    return Q.na_start_station_name_count(_p(spark, sf_dir).complete)


@query("na_summary")
def q_na_summary(spark, sf_dir):
    return Q.na_summary(_p(spark, sf_dir).complete, RIDE_COLUMNS)


on_cube("mean_ride_length", Q.mean_ride_length)
on_cube("max_ride_length", Q.max_ride_length)
on_cube("mode_day_of_week", Q.mode_day_of_week)
on_cube("day_label_from_index", Q.day_label_from_index)
on_cube("summary_statistics", Q.summary_statistics)

# -------------------------------------------------------- grouped summaries

for _name in [
    "ride_share_by_member_type",
    "short_rides_summary",
    "rides_by_rideable_type_and_member_type",
    "bike_usage_by_type",
    "rideable_type_distribution",
    "rides_by_type_and_day",
    "rides_by_type_and_hour",
    "rides_by_weekend_weekday",
    "average_ride_length_by_member",
    "average_ride_length_by_day",
    "rides_by_day",
    "hourly_rides",
    "ride_frequency_by_day",
    "member_vs_casual_usage",
    "avg_ride_duration_by_type",
    "avg_ride_duration",
    "monthly_rides",
    "rides_by_month",
    "monthly_ride_count",
    "bike_usage_by_month_type",
    "average_trip_distance",
]:
    on_cube(_name, getattr(S, _name))

for _name in [
    "ride_count_by_location",
    "frequent_casual_riders",
    "ride_repetition",
]:
    on_cleaned(_name, getattr(S, _name))

for _name in ["ride_length_stats", "ride_length_stats_minutes"]:
    on_lengths(_name, getattr(S, _name))


@query("station_utilization")
def q_station_utilization(spark, sf_dir):
    return S.busiest_first(_p(spark, sf_dir).utilization)


# ----------------------------------------------------------------- ranking

for _name in [
    "popular_start_stations",
    "popular_end_stations",
    "top_start_stations",
    "top_end_stations",
    "popular_start_stations_by_member",
    "popular_end_stations_by_member",
    "top_start_stations_by_member",
    "top_end_stations_by_member",
    "station_starts_by_member",
    "station_ends_by_member",
]:
    on_stations(_name, getattr(R, _name))

@query("top_utilized_stations")
def q_top_utilized_stations(spark, sf_dir):
    return R.top_utilized_stations(_p(spark, sf_dir).utilization)



on_stations(
    "sort_by",
    lambda c: R.sort_by(R.popular_start_stations_by_member(c), "member_casual", "-ride_count", "start_station_name"),
)
on_stations(
    "first_row",
    lambda c: R.first_row(
        R.popular_start_stations(c), [F.col("ride_count").desc(), F.col("start_station_name").asc_nulls_last()], "start_station_name"
    ),
)
on_stations("display_order", lambda c: R.display_order(R.top_start_stations_by_member(c), "start_station_name", "ride_count"))

# ---------------------------------------------------------- chart statistics

on_lengths("ride_length_histogram", CH.ride_length_histogram)
on_cube("rides_by_day_counts", CH.rides_by_day_counts)


@query("ride_length_boxplot")
def q_ride_length_boxplot(spark, sf_dir):
    prep = _p(spark, sf_dir)
    return CH.ride_length_boxplot(prep.lengths, stats=prep.quartiles)


@query("ride_length_outliers")
def q_ride_length_outliers(spark, sf_dir):
    prep = _p(spark, sf_dir)
    out = CH.ride_length_outliers(prep.cleaned, stats=prep.quartiles)
    return out.select("ride_id", "member_casual", "ride_length", "ride_length_min")


on_cube("stack_positions", lambda c: CH.stack_positions(S.rides_by_month(c), ["month"], "member_casual", "number_of_rides"))
on_cube("percent_label", lambda c: CH.ride_share_positions(S.ride_share_by_member_type(c)))
on_cleaned("distance_vs_length", CH.distance_vs_length)
on_cleaned("distance_length_bins", CH.distance_length_bins)
on_cleaned("rides_by_start_location", CH.rides_by_start_location)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
