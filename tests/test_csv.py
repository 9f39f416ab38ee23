import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import types as T

from cadence.operators import summaries as S
from cadence.operators.features import add_features
from cadence.sources import csv as CSV
from tests.fixtures import edge_frame

HEADER = "ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual\n"


def test_read_rides_csv_nulls_trim_and_zulu(spark):
    d = tempfile.mkdtemp(prefix="cadence-csv-")
    p = os.path.join(d, "m1.csv")
    with open(p, "w") as f:
        f.write(HEADER)
        f.write('a1,classic_bike,2024-03-04 08:00:00,2024-03-04T08:05:00Z,, S1 ,"",NA,41.9,-87.6,NA,-87.5,  member  \n')
        f.write("a2,electric_bike,2024-03-04T09:00:00.123456Z,2024-03-04 09:10:00.123456,Alpha,S2,Beta,S3,41.9,-87.6,41.95,-87.5,casual\n")
    got = {r.ride_id: r for r in CSV.read_rides_csv(spark, p).collect()}
    a1 = got["a1"]
    assert a1.start_station_name is None and a1.end_station_name is None and a1.end_station_id is None
    assert a1.start_station_id == "S1" and a1.member_casual == "member" and a1.end_lat is None
    assert a1.started_at == dt.datetime(2024, 3, 4, 8, 0) and a1.ended_at == dt.datetime(2024, 3, 4, 8, 5)
    assert got["a2"].started_at == dt.datetime(2024, 3, 4, 9, 0, 0, 123456)


def test_round_trip_and_combine(spark):
    d = tempfile.mkdtemp(prefix="cadence-csv-")
    rides = edge_frame(spark)
    CSV.write_rides_csv(rides, os.path.join(d, "all"))
    back = CSV.read_rides_csv(spark, os.path.join(d, "all"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rides.collect()), key=str)
    halves = [rides.filter("ride_id < 'r10'"), rides.filter("ride_id >= 'r10'").select(*reversed(rides.columns))]
    assert CSV.combine_ride_files(halves).count() == rides.count()
    assert CSV.combine_ride_files(halves).columns == rides.columns
    CSV.write_rides_csv(rides.filter("ride_id < 'r10'"), os.path.join(d, "m1"))
    CSV.write_rides_csv(rides.filter("ride_id >= 'r10'"), os.path.join(d, "m2"))
    by_path = CSV.combine_ride_files([os.path.join(d, "m1"), os.path.join(d, "m2")], spark)
    assert sorted(map(tuple, by_path.collect()), key=str) == sorted(map(tuple, rides.collect()), key=str)


def test_summary_export_round_trip(spark):
    d = tempfile.mkdtemp(prefix="cadence-csv-")
    by_day = S.rides_by_day(add_features(edge_frame(spark)))
    CSV.write_summary_csv(by_day, os.path.join(d, "rides_by_day.csv"))
    schema = T.StructType([T.StructField("day_of_week", T.StringType()), T.StructField("member_casual", T.StringType()), T.StructField("number_of_rides", T.LongType())])
    back = CSV.read_summary_csv(spark, os.path.join(d, "rides_by_day.csv"), schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, by_day.collect()))
    with open(os.path.join(d, "rides_by_day.csv")) as f:  # a plain file
        assert f.readline().strip() == "day_of_week,member_casual,number_of_rides"
    assert [f for f in os.listdir(d) if not f.startswith(".")] == ["rides_by_day.csv"]
    CSV.write_summary_csv(by_day.limit(1), os.path.join(d, "rides_by_day.csv"))  # replaced
    assert CSV.read_summary_csv(spark, os.path.join(d, "rides_by_day.csv"), schema).count() == 1
    CSV.write_summary_csv(by_day.limit(0), os.path.join(d, "none.csv"))
    assert open(os.path.join(d, "none.csv")).read().strip() == "day_of_week,member_casual,number_of_rides"


def test_a_large_frame_is_no_summary(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="cadence-csv-")
    monkeypatch.setattr(CSV, "MAX_SUMMARY_ROWS", 5)
    with pytest.raises(ValueError, match="not a summary"):
        CSV.write_summary_csv(spark.range(6), os.path.join(d, "n.csv"))
    assert os.listdir(d) == []
    CSV.write_summary_csv(spark.range(6), os.path.join(d, "n.csv"), single_file=False)
    assert CSV.read_summary_csv(spark, os.path.join(d, "n.csv"), "id long").count() == 6


def test_parquet_by_month_round_trip_and_pruning(spark):
    from cadence.plans.inspect import plan_text
    from cadence.sources.parquet import read_rides_parquet, write_rides_parquet

    d = os.path.join(tempfile.mkdtemp(prefix="cadence-pq-"), "rides")
    rides = edge_frame(spark)
    write_rides_parquet(rides, d)
    back = read_rides_parquet(spark, d)
    assert back.schema == rides.schema
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rides.collect()), key=str)
    march = read_rides_parquet(spark, d, ["2024-03"])
    assert march.count() == rides.count()
    assert "PartitionFilters: [isnotnull(ride_month" in plan_text(march, "simple")
    assert read_rides_parquet(spark, d, ["2023-01"]).count() == 0
    from cadence.schema import RIDE_COLUMNS, RIDES

    assert RIDES.fieldNames() == RIDE_COLUMNS  # the shared schema is not modified


def test_end_to_end_run_writes_the_exports(spark):
    from cadence.__main__ import run

    out = os.path.join(tempfile.mkdtemp(prefix="cadence-run-"), "out")
    recap = run(spark, out, events="/root/testdata/sf0.001")
    assert {r["section"] for r in recap} >= {"Mean ride length", "Mode day of the week"}
    by_day = CSV.read_summary_csv(spark, os.path.join(out, "rides_by_day.csv"), "day_of_week string, member_casual string, number_of_rides bigint")
    assert by_day.count() == 14 and sum(r.number_of_rides for r in by_day.collect()) == 921
    first = by_day.first()
    assert first.day_of_week == "Sunday"  # calendar order in the export


def test_cli_main_prints_the_recap_in_order(spark, capsys):
    from cadence.__main__ import main

    out = os.path.join(tempfile.mkdtemp(prefix="cadence-cli-"), "out")
    main(["--events", "/root/testdata/sf0.001", "--out", out])
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0].startswith("Mean ride length: ") and lines[2].startswith("Mode day of the week: ")
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["average_ride_length_by_day.csv", "average_ride_length_by_member.csv", "rides_by_day.csv"]


def test_export_shapes_match_the_reference_files(spark):
    """Headers and row counts of the three exports (the reference's export
    sizes fit these headers with 2, 14 and 14 rows)."""
    from cadence.__main__ import run

    out = os.path.join(tempfile.mkdtemp(prefix="cadence-exp-"), "out")
    run(spark, out, events="/root/testdata/sf0.01")
    expected = {
        "average_ride_length_by_member.csv": ("member_casual,average_ride_length", 2),
        "average_ride_length_by_day.csv": ("day_of_week,member_casual,average_ride_length", 14),
        "rides_by_day.csv": ("day_of_week,member_casual,number_of_rides", 14),
    }
    for name, (header, rows) in expected.items():
        lines = open(os.path.join(out, name)).read().splitlines()
        assert lines[0] == header and len(lines) - 1 == rows
