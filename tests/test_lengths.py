"""Exact length statistics against DuckDB on lengths with microseconds."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cadence.operators import chartdata as CH
from cadence.operators import summaries as S
from cadence.operators.cube import mean_length, ride_cube
from cadence.operators.lengths import exact_quantiles, length_table
from cadence.plans.inspect import plan_text
from cadence.plans.prepare import prepared
from tests.conftest import SF001


def _rows():
    rnd = random.Random(5)
    rows = [("member", rnd.randrange(1, 9_000_000_000) / 1e6) for _ in range(4001)]
    rows += [("casual", rnd.choice([0.5, 1.000001, 77.25, 77.250001, 9e5])) for _ in range(500)]
    return rows + [("solo", 3.25), ("member", None), (None, 4.0), (None, 5.0), ("below", -7.5), ("below", -7.25)]


@pytest.fixture(scope="module")
def rides(spark):
    return spark.createDataFrame(_rows(), "member_casual string, ride_length double").repartition(5)


def _duck(sql):
    con = duckdb.connect()
    con.execute("create table r (member_casual varchar, ride_length double)")
    con.executemany("insert into r values (?, ?)", _rows())
    return {row[0]: row[1:] for row in con.execute(sql).fetchall()}


def test_quantiles_by_rank_are_exact(rides):
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r[0]: r[1:] for r in exact_quantiles(length_table(rides), probs).collect()}
    want = _duck("select member_casual, " + ", ".join(f"quantile_cont(ride_length, {p})" for p in probs) + " from r group by 1")
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-14), k


def test_stats_from_rides_and_from_the_table_agree(rides):
    a = {tuple(r) for r in S.ride_length_stats(rides).collect()}
    assert a == {tuple(r) for r in S.ride_length_stats(length_table(rides)).collect()}
    want = _duck("select member_casual, avg(ride_length), median(ride_length), max(ride_length) from r group by 1")
    for k, *v in a:
        assert v == pytest.approx(want[k], rel=1e-12)


def test_boxplot_and_outliers(spark, rides):
    want = _duck(
        """with q as (select member_casual as g, quantile_cont(ride_length, 0.25) as a, quantile_cont(ride_length, 0.75) as b from r group by 1)
        select g, count(*) filter (ride_length < a - 1.5 * (b - a) or ride_length > b + 1.5 * (b - a))
        from r join q on r.member_casual is not distinct from g where ride_length is not null group by 1"""
    )
    got = {r["member_casual"]: r["outliers"] for r in CH.ride_length_boxplot(rides).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    assert CH.ride_length_outliers(rides).count() == sum(got.values()) > 0
    assert CH.ride_length_boxplot(rides.limit(0)).count() == 0


def test_cube_means_equal_direct_means_to_the_last_bit(spark, rides):
    keys = {
        "rideable_type": "'x'", "day_of_week_num": "cast(ride_length * 7 as int) % 7", "day_of_week": "'Monday'",
        "hour_of_day": "cast(ride_length as int) % 24", "month_start": "TIMESTAMP_NTZ'2024-01-01 00:00:00'",
    }
    full = rides.filter("ride_length > 0").withColumns({k: F.expr(v) for k, v in keys.items()})
    cube = ride_cube(full)
    direct = {tuple(r) for r in full.groupBy("member_casual").agg(mean_length(full)).collect()}
    assert direct == {tuple(r) for r in cube.groupBy("member_casual").agg(mean_length(cube)).collect()}


def test_no_quantile_gathers_a_rider_type(spark):
    prep = prepared(spark, SF001)
    for df in (S.ride_length_stats(prep.cleaned), CH.quartiles(prep.cleaned)):
        text = plan_text(df, "simple")
        assert "percentile" not in text and "ObjectHashAggregate" not in text
        assert "hashpartitioning(member_casual" in text and "ride_length" in text.split("hashpartitioning(member_casual")[-1]


def test_prepared_tables_are_built_once(spark):
    prep = prepared(spark, SF001)
    assert prep.quartiles is prep.quartiles and prep.lengths is prep.lengths and prep.utilization is prep.utilization
    other = prep.with_min_seconds(60)
    assert other.lengths.agg(F.min("ride_length")).first()[0] > 60
