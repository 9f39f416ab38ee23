"""Seeded random rides (few ids and names, many same-instant starts) against
the brute-force cleaning reference, on both the written and the lazy plan."""

import datetime as dt
import random

import pytest

from cadence.plans.prepare import prepare_rides
from tests.fixtures import brute_clean, brute_lookups, edge_frame

T0 = dt.datetime(2024, 5, 1, 6, 0, 0)


def random_rides(seed, n=120):
    rnd = random.Random(seed)
    ids = ["A", "B", "C", "D", None]
    names = {"A": ["Alpha", "Alpha 2", None], "B": ["Beta", None], "C": ["Gamma", "Gamma (Temp)"], "D": ["Delta"], None: ["Ghost", None]}
    rows = []
    for i in range(n):
        s, e = rnd.choice(ids), rnd.choice(ids[:4] + ["Z"])
        start = T0 + dt.timedelta(seconds=rnd.choice([0, 0, 1, 2, 3, 5, 8]))  # many ties
        length = rnd.choice([-3, 0, 5, 10, 11, 45, 59, 60, 61, 600, 4000])
        rows.append(
            (
                f"R{rnd.randint(0, 60):03d}",
                rnd.choice(["classic_bike", "electric_bike", "docked_bike"]),
                start,
                start + dt.timedelta(seconds=length),
                rnd.choice(names[s]),
                s,
                rnd.choice(names.get(e, ["Zed", None])),
                e if rnd.random() > 0.05 else None,
                41.9,
                -87.6,
                None if rnd.random() < 0.03 else 41.91,
                -87.62,
                rnd.choice(["member", "casual"]),
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("persist", [True, False], ids=["written", "lazy"])
def test_random_rides_match_brute_force(spark, seed, persist):
    rows = random_rides(seed)
    p = prepare_rides(edge_frame(spark, rows), persist=persist)
    end_lk, start_lk = brute_lookups(rows)
    assert {r[0]: r[1] for r in p.end_lookup.collect()} == end_lk
    assert {r[0]: r[1] for r in p.start_lookup.collect()} == start_lk
    expected = sorted(((r[0], r[4], r[6]) for r in brute_clean(rows)), key=str)
    got = sorted(((r.ride_id, r.start_station_name, r.end_station_name) for r in p.cleaned.collect()), key=str)
    assert got == expected


def test_random_rides_exercise_the_tie_pass(spark):
    """The seeds above do produce same-instant ties with different names."""
    tied = 0
    for seed in (1, 2, 3):
        p = prepare_rides(edge_frame(spark, random_rides(seed)), persist=True)
        tied += p.extras["firsts"].filter("tied").count()
    assert tied > 0


def test_fallback_without_broadcast_is_exact(spark):
    """Above the broadcast bound the fills become shuffle joins (AQE splits a
    hot id); results must not change. One start station holds a third of
    the rides here."""
    from cadence.plans.inspect import plan_text

    rows = random_rides(7, n=150)
    hot = [r[:5] + ("A",) + r[6:] for r in rows[:50]]  # a third of rides start at A
    rows = hot + rows[50:]
    spark.conf.set("cadence.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no planner broadcast either
    try:
        p = prepare_rides(edge_frame(spark, rows), persist=True)
        text = plan_text(p.filled(), "simple")
        assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
        expected = sorted(((r[0], r[4], r[6]) for r in brute_clean(rows)), key=str)
        got = sorted(((r.ride_id, r.start_station_name, r.end_station_name) for r in p.cleaned.collect()), key=str)
        assert got == expected
    finally:
        spark.conf.unset("cadence.broadcast.maxRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
