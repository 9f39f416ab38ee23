"""Summaries from the ride cube equal the same summaries computed directly."""

import pytest

from cadence.operators import chartdata as CH
from cadence.operators import quality as Q
from cadence.operators import report as RP
from cadence.operators import summaries as S
from cadence.operators.cube import ride_cube
from cadence.plans.prepare import prepared
from tests.conftest import SF001

CUBE_ABLE = [
    S.ride_share_by_member_type, S.short_rides_summary, S.rides_by_rideable_type_and_member_type, S.bike_usage_by_type,
    S.rideable_type_distribution, S.rides_by_type_and_day, S.rides_by_type_and_hour, S.rides_by_weekend_weekday,
    S.average_ride_length_by_member, S.average_ride_length_by_day, S.rides_by_day, S.hourly_rides, S.ride_frequency_by_day,
    S.member_vs_casual_usage, S.avg_ride_duration_by_type, S.avg_ride_duration, S.monthly_rides, S.rides_by_month,
    S.monthly_ride_count, S.bike_usage_by_month_type, Q.mean_ride_length, Q.max_ride_length, Q.mode_day_of_week,
    Q.day_label_from_index, Q.summary_statistics, CH.rides_by_day_counts, RP.analysis_summary,
]


@pytest.fixture(scope="module")
def both(spark):
    c = prepared(spark, SF001).cleaned
    return c, ride_cube(c)


@pytest.mark.parametrize("fn", CUBE_ABLE, ids=lambda f: f.__name__)
def test_cube_equals_direct(both, fn):
    rides, cube = both
    direct, from_cube = fn(rides), fn(cube)
    assert direct.columns == from_cube.columns
    assert dict(direct.dtypes) == dict(from_cube.dtypes)
    assert sorted(map(tuple, direct.collect()), key=str) == sorted(map(tuple, from_cube.collect()), key=str)


def test_cube_is_small(both):
    rides, cube = both
    assert cube.count() <= 2 * 3 * 7 * 24 * 13


from cadence.operators import ranking as R  # noqa: E402
from cadence.operators.cube import station_table  # noqa: E402
from cadence.operators.features import add_features  # noqa: E402
from tests.fixtures import edge_frame  # noqa: E402

STATION_ABLE = [
    R.popular_start_stations, R.popular_end_stations, R.top_start_stations, R.top_end_stations,
    R.popular_start_stations_by_member, R.popular_end_stations_by_member, R.top_start_stations_by_member,
    R.top_end_stations_by_member, R.station_starts_by_member, R.station_ends_by_member,
]


@pytest.mark.parametrize("fn", STATION_ABLE, ids=lambda f: f.__name__)
@pytest.mark.parametrize("source", ["generated", "edge"])
def test_station_table_equals_direct(spark, both, fn, source):
    rides = both[0] if source == "generated" else add_features(edge_frame(spark))  # edge rows have null names
    direct, from_table = fn(rides), fn(station_table(rides))
    assert direct.columns == from_table.columns and dict(direct.dtypes) == dict(from_table.dtypes)
    assert sorted(map(tuple, direct.collect()), key=str) == sorted(map(tuple, from_table.collect()), key=str)


def test_report_lines_from_cube(spark, both):
    from cadence.plans.prepare import prepared

    complete = prepared(spark, SF001).complete
    rides, cube = both
    assert sorted(map(tuple, Q.report_lines(complete, rides).collect())) == sorted(map(tuple, Q.report_lines(complete, cube).collect()))


def test_summary_tables_split_equals_separate_tables(spark, both):
    from cadence.operators.cube import cube_of, stations_of, summary_tables

    rides, cube = both
    tables = summary_tables(rides)
    for a, b in [(cube_of(tables), cube), (stations_of(tables), station_table(rides))]:
        assert a.columns == b.columns and dict(a.dtypes) == dict(b.dtypes)
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    edge = add_features(edge_frame(spark))
    t = summary_tables(edge)
    assert sorted(map(tuple, stations_of(t).collect()), key=str) == sorted(map(tuple, station_table(edge).collect()), key=str)
