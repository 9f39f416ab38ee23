"""The plan shapes the scale story depends on."""

import pytest

from cadence.operators import clean as K
from cadence.operators import ranking as R
from cadence.operators import summaries as S
from cadence.plans import catalog
from cadence.plans.inspect import has_python, operators, plan_text
from cadence.plans.prepare import prepared
from tests.conftest import SF001


@pytest.fixture(scope="module")
def prep(spark):
    return prepared(spark, SF001)


def test_names_are_reduced_by_station_keys_inside_the_tasks(prep):
    plan = K.station_names(prep.matched_rides())
    ops = operators(plan)
    assert "HashAggregate" in ops and not any("SortAggregate" in o for o in ops)
    assert any("BroadcastHashJoin LeftSemi" in o for o in ops)
    text = plan_text(plan, "simple")
    assert "partial_min(started_at" in text and "hashpartitioning(side" in text
    # the table has a row for a station and a name, not for a pair of stations
    assert prep.names.count() < prep.matching.count() / 2


def test_fills_broadcast_the_lookups(prep):
    ops = operators(prep.filled())
    assert sum("BroadcastHashJoin LeftOuter" in o for o in ops) == 2
    assert not any("SortMergeJoin" in o for o in ops)


def test_summaries_push_the_length_filter_and_prune_columns(prep):
    text = plan_text(S.hourly_rides(prep.cleaned), "simple")
    assert "GreaterThan(ride_length,10.0)" in text
    assert "ReadSchema: struct<member_casual:string,ride_length:double,hour_of_day:int>" in text
    assert "partial_count" in text  # map-side combine before the shuffle


def test_global_top_k_compares_with_a_cut_value(prep):
    """The n-th largest count comes from n rows a task; the stations themselves are
    filtered where they are, so ties meet in no single partition."""
    text = plan_text(R.top_start_stations(prep.stations), "simple")
    assert "Subquery" in text and "TakeOrderedAndProject(limit=10" in text
    assert "Window" not in text and "SinglePartition" not in text


def test_grouped_top_k_limits_before_the_shuffle(prep):
    text = plan_text(R.top_start_stations_by_member(prep.cleaned), "simple")
    assert "WindowGroupLimit" in text and "LeftSemi" in text


def test_distinct_count_is_two_level(prep):
    text = plan_text(S.station_utilization(prep.cleaned), "simple")
    assert "hashpartitioning(start_station_name" in text and "ride_id" in text.split("hashpartitioning(start_station_name")[-1]


def test_no_python_and_no_pair_joins_in_any_catalog_plan(spark):
    for name, fn in catalog.queries().items():
        df = fn(spark, SF001)
        assert not has_python(df), name
        text = plan_text(df, "simple")
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_spread_only_for_single_split_inputs(spark):
    from cadence.plans.prepare import spread_if_few_partitions
    from cadence.plans.session import cluster_conf, shuffle_partitions_for

    one = spark.range(1000).coalesce(1)
    assert spread_if_few_partitions(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(3)
    assert "RoundRobinPartitioning(" + str(spark.sparkContext.defaultParallelism) not in plan_text(spread_if_few_partitions(many), "simple")
    assert shuffle_partitions_for(100 << 40) == 32768 and shuffle_partitions_for(1 << 20) == 8
    assert cluster_conf(100 << 40)["spark.sql.shuffle.partitions"] == "32768"
