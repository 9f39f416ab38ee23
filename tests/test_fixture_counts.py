"""Row counts measured independently for the generated rides (FIXTURES.md §2)."""

import pytest

from cadence.operators import clean as K
from cadence.operators import summaries as S
from cadence.plans.prepare import prepared
from tests.conftest import SF001, SF01

EXPECTED = {
    SF001: dict(rides=1000, matched=118, end_null=(53, 51), complete=927, null_start=5, le0=1, le10=6, cleaned=921,
                short=29, member=596, casual=325, classic=544, electric=361, docked=16, frequent=0, top=11),
    SF01: dict(rides=10000, matched=9366, end_null=(527, 203), complete=9564, null_start=0, le0=36, le10=93, cleaned=9471,
               short=307, member=6159, casual=3312, classic=5601, electric=3725, docked=145, frequent=10, top=16),
}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_counts(spark, sf):
    e = EXPECTED[sf]
    p = prepared(spark, sf)
    assert p.raw.count() == e["rides"]
    assert p.matched_rides().count() == e["matched"]
    assert (p.raw.filter("end_station_name is null").count(), p.filled_end().filter("end_station_name is null").count()) == e["end_null"]
    assert p.complete.count() == e["complete"]
    assert p.complete.filter("start_station_name is null").count() == e["null_start"]
    assert K.zero_or_negative_rides(p.complete).count() == e["le0"]
    assert p.complete.filter("ride_length <= 10").count() == e["le10"]
    c = p.cleaned
    assert c.count() == e["cleaned"]
    assert K.short_rides(c).count() == e["short"]
    by_member = {r.member_casual: r.total_rides for r in S.ride_share_by_member_type(c).collect()}
    assert by_member == {"member": e["member"], "casual": e["casual"]}
    by_type = {r.rideable_type: r["count"] for r in c.groupBy("rideable_type").count().collect()}
    assert by_type == {"classic_bike": e["classic"], "electric_bike": e["electric"], "docked_bike": e["docked"]}
    assert S.frequent_casual_riders(c).count() == e["frequent"]
    from cadence.operators.ranking import top_start_stations

    assert top_start_stations(c).count() == e["top"]
