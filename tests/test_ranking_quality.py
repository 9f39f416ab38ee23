import datetime as dt

from pyspark.sql import functions as F

from cadence.operators import quality as Q
from cadence.operators import ranking as R
from cadence.operators import summaries as S
from cadence.operators.features import add_features
from tests.fixtures import edge_frame, ride


def station_rides(spark, counts):
    """Rides with start station 'S<i>' repeated counts[i] times."""
    rows = []
    k = 0
    for i, n in enumerate(counts):
        for _ in range(n):
            rows.append(ride(f"x{k}", k, 120, f"S{i}", f"Station {i:02d}", "A", "Alpha"))
            k += 1
    return add_features(edge_frame(spark, rows))


def test_top_with_ties_keeps_ties_and_head_does_not(spark):
    # 12 stations: counts 20..11 for the first ten, then one more tied at 11
    counts = [20, 19, 18, 17, 16, 15, 14, 13, 12, 11, 11, 3]
    rides = station_rides(spark, counts)
    top = R.top_start_stations(rides)
    assert top.count() == 11
    assert R.top_utilized_stations(S.station_utilization(rides)).count() == 10
    first = R.first_row(R.popular_start_stations(rides), [F.desc("ride_count")], "start_station_name").first()[0]
    assert first == "Station 00"


def test_top_by_member_per_group(spark):
    counts = [5, 4, 3, 2, 1] * 3  # three stations tie for first place
    rides = station_rides(spark, counts)
    got = R.top_start_stations_by_member(rides, n=2)
    assert sorted(r.ride_count for r in got.collect()) == [5, 5, 5]
    got4 = R.top_start_stations_by_member(rides, n=4)
    assert sorted(r.ride_count for r in got4.collect()) == [4, 4, 4, 5, 5, 5]


def test_station_head_per_station_keeps_everything(spark):
    rides = add_features(edge_frame(spark))
    full = rides.groupBy("start_station_name", "member_casual").count().count()
    assert R.station_starts_by_member(rides).count() == full


def test_display_order_uses_mean_over_panels(spark):
    df = spark.createDataFrame(
        [("member", "a", 10), ("casual", "a", 2), ("member", "b", 5), ("casual", "c", 7)],
        "member_casual string, start_station_name string, ride_count bigint",
    )
    got = [(r.start_station_name, r.order_value, r.position) for r in R.display_order(df, "start_station_name", "ride_count").collect()]
    assert sorted(got, key=lambda x: x[2]) == [("b", 5.0, 1), ("a", 6.0, 2), ("c", 7.0, 3)]


def test_unique_bikes_counts_null_ride_id_once(spark):
    rows = [ride(None, 0, 100, "A", "Alpha", "A", "Alpha"), ride(None, 1, 100, "A", "Alpha", "A", "Alpha"), ride("r1", 2, 100, "A", "Alpha", "A", "Alpha")]
    got = S.station_utilization(add_features(edge_frame(spark, rows))).first()
    assert (got.station_rides, got.unique_bikes) == (3, 2)


def test_mode_tie_goes_to_earlier_day(spark):
    sunday, monday = dt.datetime(2024, 3, 10, 9), dt.datetime(2024, 3, 11, 9)
    rows = []
    for i, start in enumerate([monday, monday, sunday, sunday]):
        r = ride(f"m{i}", 0, 100, "A", "Alpha", "A", "Alpha")
        rows.append(r[:2] + (start, start + dt.timedelta(seconds=100)) + r[4:])
    df = add_features(edge_frame(spark, rows))
    assert Q.mode_day_of_week(df).first()[0] == "Sunday"
    stats = {r.metric: r.value for r in Q.summary_statistics(df).collect()}
    assert stats == {"Mean Ride Length": "100 secs", "Max Ride Length": "100 secs", "Mode Day of the Week": "Sunday"}


def test_invariants_on_generated_rides(spark):
    from cadence.plans.prepare import prepared

    c = prepared(spark, "/root/testdata/sf0.001").cleaned
    total = c.count()
    share = S.ride_share_by_member_type(c).collect()
    assert sum(r.total_rides for r in share) == total
    assert abs(sum(r.proportion for r in share) - 1.0) < 1e-12
    a = {(r.rideable_type, r.member_casual): r.ride_count for r in S.bike_usage_by_type(c).collect()}
    b = {(r.rideable_type, r.member_casual): r.ride_count for r in S.rides_by_rideable_type_and_member_type(c).collect()}
    assert a == b and sum(a.values()) == total
    assert sum(r.number_of_rides for r in S.rides_by_day(c).collect()) == total
    assert sum(r["count"] for r in S.short_rides_summary(c).collect()) == c.filter("ride_length < 60").count()
    na = Q.na_summary(prepared(spark, "/root/testdata/sf0.001").complete).first().asDict()
    for col in ["end_station_name", "end_station_id", "end_lat", "end_lng", "start_station_id", "start_lat", "start_lng"]:
        assert na[col] == 0
