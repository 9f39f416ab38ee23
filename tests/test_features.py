import datetime as dt

from pyspark.sql import functions as F

from cadence.functions import columns as C
from cadence.functions.text import percent_label, r_format_digits
from cadence.operators.chartdata import histogram_bin
from cadence.operators.features import add_features
from tests.fixtures import edge_frame, ride


def test_weekday_weekend_boundaries(spark):
    rows = [
        ride("sat", 0, 60, "A", "a", "A", "a"),
        ride("sun", 0, 60, "A", "a", "A", "a"),
        ride("mon", 0, 60, "A", "a", "A", "a"),
    ]
    starts = [dt.datetime(2024, 3, 9, 23, 59), dt.datetime(2024, 3, 10, 0, 0), dt.datetime(2024, 3, 11, 0, 0)]
    rows = [r[:2] + (s, s + dt.timedelta(seconds=60)) + r[4:] for r, s in zip(rows, starts)]
    out = {r.ride_id: r for r in add_features(edge_frame(spark, rows)).collect()}
    assert (out["sat"].day_of_week, out["sat"].is_weekend, out["sat"].day_of_week_num) == ("Saturday", "Weekend", 7)
    assert (out["sun"].day_of_week, out["sun"].is_weekend, out["sun"].day_of_week_num) == ("Sunday", "Weekend", 1)
    assert (out["mon"].day_of_week, out["mon"].is_weekend) == ("Monday", "Weekday")
    assert out["sat"].hour_of_day == 23 and out["sun"].hour_of_day == 0


def test_month_columns_and_distance(spark):
    df = add_features(edge_frame(spark))
    r = df.filter("ride_id = 'r01'").first()
    assert r.month_label == "Mar" and r.month_num == 3 and r.month_name == "March"
    assert r.month_start == dt.datetime(2024, 3, 1)
    assert dict(df.dtypes)["month_start"] == "timestamp_ntz"
    assert abs(r.trip_distance - (0.01**2 + 0.02**2) ** 0.5) < 1e-12
    assert r.ride_length == 300.0 and r.ride_length_min == 5.0


def test_fractional_lengths(spark):
    df = add_features(edge_frame(spark)).select("ride_id", "ride_length")
    got = {r.ride_id: r.ride_length for r in df.collect()}
    assert got["r15"] == -5.0 and got["r16"] == 0.0 and got["r18"] == 10.5 and got["r19"] == 59.9


def test_histogram_bins_centered_right_closed(spark):
    df = spark.createDataFrame([(2.5,), (2.6,), (7.5,), (-2.5,), (0.0,)], "m double")
    got = [r.b for r in df.select(histogram_bin(F.col("m")).alias("b")).collect()]
    assert got == [0.0, 5.0, 5.0, -5.0, 0.0]


def test_text_helpers(spark):
    df = spark.createDataFrame([(734.6, 0.648), (14701.0, 0.352), (1.234, 0.5), (0.01234, 0.0)], "x double, p double")
    out = df.select(r_format_digits("x").alias("t"), percent_label("p").alias("pct"), percent_label("p", 1).alias("pct1")).collect()
    assert [r.t for r in out] == ["735", "14701", "1.2", "0.012"]
    assert [r.pct for r in out] == ["65%", "35%", "50%", "0%"]
    assert out[0].pct1 == "64.8%"


def test_day_label(spark):
    df = spark.createDataFrame([(1,), (7,)], "i int")
    assert [r.d for r in df.select(C.day_label("i").alias("d")).collect()] == ["Sunday", "Saturday"]


def test_percent_decimals_follow_the_gaps(spark):
    from cadence.functions.text import percent_decimals

    cases = [
        ([0.524, 0.476], ["52.4%", "47.6%"]),
        ([0.648, 0.352], ["65%", "35%"]),
        ([0.5, 0.5], ["50%", "50%"]),
        ([1.0], ["100%"]),
        ([], []),
        ([0.05, 0.1, 0.15], ["5%", "10%", "15%"]),  # a decimal would be zero everywhere
        ([0.333, 0.333 + 1e-12, 0.4], ["33%", "33%", "40%"]),  # a gap of rounding tells nothing
        ([0.12345, 0.1235, 0.9], ["12.345%", "12.350%", "90.000%"]),
        ([0.2, None, float("nan"), 0.225], ["20.0%", None, "NaN%", "22.5%"]),
    ]
    for values, labels in cases:
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
        k = percent_decimals(F.array(*[F.lit(v).cast("double") for v in values])) if values else percent_decimals(F.lit([]).cast("array<double>"))
        got = [r.t for r in rows.orderBy("i").select(percent_label("p", k).alias("t")).collect()]
        assert [t if t is None or "NaN" not in labels[i] else labels[i] for i, t in enumerate(got)] == labels


def test_share_labels_use_them(spark):
    from cadence.operators.chartdata import ride_share_positions

    def labels(*counts):
        share = spark.createDataFrame([(f"m{i}", n, n / sum(counts)) for i, n in enumerate(counts)], "member_casual string, total_rides long, proportion double")
        return [r.label for r in ride_share_positions(share).orderBy("member_casual").collect()]

    assert labels(524, 476) == ["52.4%", "47.6%"] and labels(65, 35) == ["65%", "35%"]
    assert labels(7, 7) == ["50%", "50%"] and labels(9) == ["100%"]


def test_units_of_elapsed_times(spark):
    from cadence.operators import quality as Q
    from cadence.operators.cube import ride_cube
    from cadence.operators.elapsed import unit_for, unit_of, with_unit
    from cadence.plans.prepare import prepare_rides

    assert [unit_for(x) for x in (None, 0.0, 59.9, 60.0, 3599.0, 3600.0, 86399.0, 86400.0, 1e9)] == [
        "secs", "secs", "secs", "mins", "mins", "hours", "hours", "days", "days"
    ]

    def shown(lengths):
        rows = [ride(f"r{i}", i, n, "A", "Alpha", "A", "Alpha") for i, n in enumerate(lengths)]
        p = prepare_rides(edge_frame(spark, rows))
        both = [{r.metric: r.value for r in Q.summary_statistics(t).collect()} for t in (p.cleaned, p.cube)]
        assert both[0] == both[1]
        return unit_of(p.cleaned, "ride_length"), both[0]["Mean Ride Length"], both[0]["Max Ride Length"]

    assert shown([300, 734]) == ("mins", "8.6 mins", "12 mins")
    assert shown([300, 734, 0]) == ("secs", "517 secs", "734 secs")  # a ride that the filter drops later decides
    assert shown([-4000, 7200, 9000]) == ("hours", "2.2 hours", "2.5 hours")
    rides = add_features(edge_frame(spark))
    assert {r.value for r in Q.summary_statistics(with_unit(rides, "ride_length", "mins")).collect() if r.metric.startswith("Max")} == {"5 mins"}
    assert unit_of(ride_cube(rides), "len_max") == "secs"


def test_mean_distance_is_the_same_in_any_order(spark):
    import math
    import random
    from fractions import Fraction

    from cadence.operators.cube import ride_cube
    from cadence.operators.summaries import average_trip_distance

    rnd = random.Random(4)
    rows = [ride(f"r{i}", i, 300, "A", "a", "A", "a", lat=rnd.uniform(-90, 89), lng=rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 2)) for i in range(3000)]
    rides = add_features(edge_frame(spark, rows))
    rides = rides.withColumn("trip_distance", F.when(F.col("ride_id") != "r7", F.col("trip_distance") * F.rand(1)))
    kept = rides.select("ride_id", "trip_distance").collect()
    got = set()
    for k in (1, 3, 17):
        mixed = spark.createDataFrame(kept, "ride_id string, trip_distance double").repartition(k).join(rides.drop("trip_distance"), "ride_id")
        for t in (mixed, ride_cube(mixed)):
            got.add(tuple(map(tuple, average_trip_distance(t).collect())))
    assert len(got) == 1
    values = [r.trip_distance for r in kept if r.trip_distance is not None]
    assert len(values) == 2999
    exact = sum(map(Fraction, values)) / len(values)
    assert abs(Fraction(next(iter(got))[0][1]) - exact) <= Fraction(1, 2**41) + Fraction(math.ulp(float(exact)))
    none = rides.limit(0)
    assert average_trip_distance(none).count() == 0


def test_drop_column_and_report_line(spark):
    import pytest

    from cadence.functions.text import report_line
    from cadence.operators.features import drop_column

    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert drop_column(df, "a").columns == ["b"]
    with pytest.raises(ValueError, match="no column A"):
        drop_column(df, "A")
    assert df.select(report_line("label:", "b").alias("t")).first().t == "label: NA"
