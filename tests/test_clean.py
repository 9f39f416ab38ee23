import pytest

from cadence.operators import clean as K
from cadence.plans.prepare import prepare_rides
from tests.fixtures import brute_clean, brute_lookups, edge_frame, edge_rides


@pytest.fixture(scope="module")
def rides(spark):
    return edge_frame(spark)


@pytest.fixture(scope="module", params=[True, False], ids=["persisted", "lazy"])
def prep(request, rides):
    return prepare_rides(rides, persist=request.param)


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_lookups_match_brute_force(prep):
    end_lk, start_lk = brute_lookups(edge_rides())
    assert as_dict(prep.end_lookup, "end_station_id", "end_station_name") == end_lk
    assert as_dict(prep.start_lookup, "start_station_id", "start_station_name") == start_lk


def test_edge_semantics(prep):
    end_lk = as_dict(prep.end_lookup, "end_station_id", "end_station_name")
    start_lk = as_dict(prep.start_lookup, "start_station_id", "start_station_name")
    assert end_lk["A"] is None  # earliest name was null and is kept
    assert end_lk["B"] == "Beta"  # earliest of two names wins
    assert start_lk["C"] == "Gamma"  # same-instant tie: smaller ride id r07
    assert None in end_lk  # null end id matched the null start id
    assert "Z" not in end_lk  # Z is never a start id
    assert "D" not in start_lk  # D only on non-matching rides


def test_cleaned_rows_match_brute_force(prep):
    expected = sorted(r[0] for r in brute_clean(edge_rides()))
    got = sorted(r.ride_id for r in prep.cleaned.select("ride_id").collect())
    assert got == expected


def test_length_filters_and_short(prep):
    ids = {r.ride_id for r in prep.cleaned.select("ride_id").collect()}
    assert {"r18", "r19", "r20"} <= ids and not ({"r15", "r16", "r17"} & ids)
    short = {r.ride_id for r in K.short_rides(prep.cleaned).select("ride_id").collect()}
    assert short == {"r18", "r19"}


def test_null_start_name_survives_and_dropped_rows(prep):
    got = {r.ride_id: r for r in prep.cleaned.collect()}
    assert "r14" in got and got["r14"].start_station_name is None
    assert "r11" not in got and "r21" not in got  # unfillable end name, missing coords


def test_fill_keeps_rows_and_non_null_names(prep, rides):
    filled = {r.ride_id: r for r in prep.filled().collect()}
    assert len(filled) == rides.count()
    for r in rides.collect():
        if r.end_station_name is not None:
            assert filled[r.ride_id].end_station_name == r.end_station_name


def test_history_variant_without_start_fill(rides):
    p = prepare_rides(rides, fill_start=False)
    expected = sorted(r[0] for r in brute_clean(edge_rides(), fill_start=False))
    assert sorted(r.ride_id for r in p.cleaned.select("ride_id").collect()) == expected
    r06 = p.filled().filter("ride_id = 'r06'").first()
    assert r06.start_station_name is None


def test_lookup_unique_after_cleaning(prep):
    for lk, k in [(prep.end_lookup, "end_station_id"), (prep.start_lookup, "start_station_id")]:
        assert lk.count() == lk.select(k).distinct().count()


def test_conflicts_list_ids_with_two_names(rides):
    names = K.station_names(K.matched_rides(rides, K.start_station_ids(rides)))
    ids = {r.end_station_id for r in K.end_station_lookup_conflicts(names).collect()}
    assert ids == {None, "A", "B"}  # the null-id group counts too


def test_fill_variant_reuses_lookups(rides):
    p = prepare_rides(rides)
    v = p.variant(fill_start=False)
    assert v.names is p.names and v.end_lookup is p.end_lookup
    expected = sorted(r[0] for r in brute_clean(edge_rides(), fill_start=False))
    assert sorted(r.ride_id for r in v.cleaned.select("ride_id").collect()) == expected
    back = v.variant(fill_start=True)
    assert sorted(r.ride_id for r in back.cleaned.select("ride_id").collect()) == sorted(r[0] for r in brute_clean(edge_rides()))


def test_other_min_seconds_reuses_complete_table(rides):
    p = prepare_rides(rides)
    q = p.with_min_seconds(0)
    assert q.complete is p.complete
    expected = sorted(r[0] for r in brute_clean(edge_rides(), min_seconds=0))
    assert sorted(r.ride_id for r in q.cleaned.select("ride_id").collect()) == expected
    assert "r17" in expected  # the 10 s ride is kept with a 0 s bound
