"""Inputs the generated tables do not hold: files that land later, reordered
CSV columns, undated rides, replaced input files, session zones with clock
changes, other thresholds on the cube."""

import gzip
import os
import shutil

import pytest

from cadence.operators import report as RP
from cadence.operators import summaries as S
from cadence.operators.cube import max_length, mean_length, ride_cube
from cadence.operators.features import add_features
from cadence.plans.prepare import prepare_rides, prepared
from cadence.sources import csv as CSV
from cadence.streaming import ingest_ride_files
from tests.conftest import SF01, SF001
from tests.fixtures import brute_clean, brute_lookups, edge_frame, ride
from tests.test_csv import HEADER
from tests.test_random_rides import random_rides

NAMES = HEADER.strip().split(",")
ROW = {
    "ride_id": "a1", "rideable_type": "classic_bike", "started_at": "2024-03-04 08:00:00", "ended_at": "2024-03-04 08:05:00",
    "start_station_name": "Alpha", "start_station_id": "S1", "end_station_name": "Beta", "end_station_id": "S2",
    "start_lat": "41.9", "start_lng": "-87.6", "end_lat": "41.95", "end_lng": "-87.5", "member_casual": "member",
}


def write(path, names, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(names), *[",".join(r.get(n, "") for n in names) for r in rows]]) + "\n")
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------- ingest


def test_ingest_with_default_checkpoint_keeps_files_of_both_landings(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    write(landing / "m1.csv", NAMES, ROW)
    assert ingest_ride_files(spark, str(landing), table).count() == 1
    write(landing / "m2.csv", NAMES, ROW | {"ride_id": "a2"})
    assert sorted(r.ride_id for r in ingest_ride_files(spark, str(landing), table).collect()) == ["a1", "a2"]
    assert ingest_ride_files(spark, str(landing), table + "/").count() == 2  # nothing new, nothing twice
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest_ride_files(spark, str(landing), table, str(tmp_path / "other"))


def test_ingest_takes_columns_by_name(spark, tmp_path):
    """Reordered and extra columns land; a lost mandatory one fails its batch, which
    is tried again once the file is mended; nothing lands twice."""
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    write(landing / "m1.csv", ["x", *NAMES], ROW)
    write(landing / "m2.csv", list(reversed(NAMES)), ROW | {"ride_id": "a2"})
    plain = rows_of(CSV.read_rides_csv(spark, write(tmp_path / "p.csv", NAMES, ROW, ROW | {"ride_id": "a2"})))
    assert rows_of(ingest_ride_files(spark, str(landing), table)) == plain
    write(landing / "m3.csv", [n for n in NAMES if n != "end_lat"], ROW | {"ride_id": "a3"})
    with pytest.raises(Exception, match="end_lat"):
        ingest_ride_files(spark, str(landing), table)
    write(landing / "m3.csv", NAMES, ROW | {"ride_id": "a3"})
    assert sorted(r.ride_id for r in ingest_ride_files(spark, str(landing), table).collect()) == ["a1", "a2", "a3"]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    """A run that died after its batch was written, before the batch was committed."""
    landing, table, ckpt = tmp_path / "landing", str(tmp_path / "table"), tmp_path / "ckpt"
    write(landing / "m1.csv", NAMES, ROW)
    ingest_ride_files(spark, str(landing), table, str(ckpt))
    for f in [ckpt / "commits" / "0", ckpt / "commits" / ".0.crc"]:
        f.rename(tmp_path / f.name)
    write(landing / "m2.csv", NAMES, ROW | {"ride_id": "a2"})
    assert sorted(r.ride_id for r in ingest_ride_files(spark, str(landing), table, str(ckpt)).collect()) == ["a1", "a2"]


def test_ingest_of_nothing(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    out = ingest_ride_files(spark, str(tmp_path / "landing"), str(tmp_path / "table"))
    assert out.count() == 0 and out.columns == NAMES


# ------------------------------------------------------------ CSV by header


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    plain = write(tmp_path / "plain.csv", NAMES, ROW)
    expected = rows_of(CSV.read_rides_csv(spark, plain))
    assert expected[0][NAMES.index("start_station_name")] == "Alpha"
    others = [
        write(tmp_path / "swapped.csv", list(reversed(NAMES)), ROW),
        write(tmp_path / "index.csv", ["row", *NAMES], ROW | {"row": "1"}),
        write(tmp_path / "unnamed.csv", ["", *NAMES], ROW | {"": "1"}),
        write(tmp_path / "extra.csv", [*NAMES[:5], "note", *NAMES[5:]], ROW | {"note": "n"}),
    ]
    for p in others:
        assert rows_of(CSV.read_rides_csv(spark, p)) == expected, p
    assert rows_of(CSV.combine_ride_files([plain, *others], spark)) == expected * 5


def test_csv_absent_columns(spark, tmp_path):
    short = write(tmp_path / "short.csv", [n for n in NAMES if n != "start_station_name"], ROW)
    (r,) = CSV.read_rides_csv(spark, short).collect()
    assert r.start_station_name is None and r.end_station_name == "Beta" and r.member_casual == "member"
    lost = write(tmp_path / "lost.csv", [n for n in NAMES if n != "end_lat"], ROW)
    with pytest.raises(ValueError, match="end_lat"):
        CSV.read_rides_csv(spark, lost)


def test_files_of_one_folder_may_differ(spark, tmp_path):
    expected = rows_of(CSV.read_rides_csv(spark, write(tmp_path / "p.csv", NAMES, ROW)))
    mixed = tmp_path / "mixed of two"
    write(mixed / "m1.csv", NAMES, ROW)
    write(mixed / "m2 (late).csv", list(reversed(NAMES)), ROW)
    write(mixed / "m3.csv", ["ride_id", "ride_id", *NAMES[1:]], ROW)
    (mixed / "blank.csv").write_text("\n\n")
    (mixed / "bom.csv").write_bytes(b"\xef\xbb\xbf" + (mixed / "m1.csv").read_bytes().replace(b"ride_id", b'"ride_id"', 1))
    assert rows_of(CSV.read_rides_csv(spark, str(mixed))) == expected * 4
    assert rows_of(CSV.combine_ride_files([f"{tmp_path}/mix*", f"{tmp_path}/p.csv"], spark)) == expected * 5


@pytest.mark.parametrize("few", [0, 1000], ids=["job", "driver"])
def test_headers_of_many_files(spark, tmp_path, monkeypatch, few):
    """Without a job, or with one job whatever the number of paths; the same groups both ways."""
    monkeypatch.setattr(CSV, "FEW_FILES", few)
    paths = [write(tmp_path / "same" / f"m{i}.csv", NAMES, *[ROW] * 40) for i in range(8)]
    spark.sparkContext.setJobGroup(f"headers {few}", "headers")
    try:
        assert CSV.header_groups(spark, paths) == {tuple(NAMES): paths}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers {few}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= (2 if few == 0 else 0)  # AQE submits the exchange and the rest of one query apart
    write(tmp_path / "same" / "other one.csv", list(reversed(NAMES)), ROW)
    with gzip.open(tmp_path / "same" / "z.csv.gz", "wt") as f:
        f.write("\n" + open(paths[0]).read())
    (tmp_path / "same" / "empty.csv").write_text("")
    groups = CSV.header_groups(spark, [str(tmp_path / "same")])
    assert {h: sorted(os.path.basename(f) for f in fs) for h, fs in groups.items()} == {
        tuple(NAMES): [*(f"m{i}.csv" for i in range(8)), "z.csv.gz"], tuple(reversed(NAMES)): ["other one.csv"],
    }
    assert CSV.read_rides_csv(spark, str(tmp_path / "same")).count() == 9 * 40 + 1


def test_problems_are_listed_with_their_lines(spark, tmp_path):
    good = ROW | {"ride_id": "ok"}
    bad_time = ROW | {"ride_id": "t", "started_at": "yesterday"}
    bad_both = ROW | {"ride_id": "b", "end_lat": "41,9N".replace(",", "."), "ended_at": "31/12/2024"}
    gap = ROW | {"ride_id": "g", "end_lat": "NA", "started_at": ""}
    a = write(tmp_path / "in" / "a.csv", NAMES, good, bad_time, gap)
    b = write(tmp_path / "in" / "b.csv", list(reversed(NAMES)), bad_both, good)
    with open(a, "a") as f:
        f.write("short,classic_bike\n")
    found = CSV.ride_problems(spark, [a, b]).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.column, r.expected, r.actual) for r in found if r.column) == [
        ("a.csv", "started_at", "timestamp", "yesterday"),
        ("b.csv", "end_lat", "double", "41.9N"),
        ("b.csv", "ended_at", "timestamp", "31/12/2024"),
    ]
    (short,) = [r for r in found if not r.column]
    assert short.line == "short,classic_bike" and short.expected == "13 cells"
    assert {r.line.split(",")[0] for r in found if r.column == "started_at"} == {"t"}
    rides, n = CSV.read_rides_checked(spark, [a, b], str(tmp_path / "rejects"))
    assert n == 4 and spark.read.parquet(str(tmp_path / "rejects")).count() == 4
    got = {r.ride_id: r for r in rides.collect()}
    assert len(got) == 5 and got["t"].started_at is None and got["b"].end_lat is None and got["b"].started_at is not None
    with pytest.raises(ValueError, match="4 cells or lines"):
        CSV.read_rides_checked(spark, [a, b], str(tmp_path / "rejects"), max_problems=3)
    assert CSV.ride_problems(spark, write(tmp_path / "fine.csv", NAMES, good, gap)).count() == 0


def test_csv_empty_file(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert CSV.read_rides_csv(spark, str(empty)).columns == NAMES
    assert CSV.read_rides_csv(spark, [str(empty), write(tmp_path / "m1.csv", NAMES, ROW)]).count() == 1


@pytest.mark.parametrize("zone", ["America/Chicago", "Europe/Berlin", "UTC"])
def test_lengths_do_not_depend_on_the_session_zone(spark, tmp_path, zone):
    times = [("2024-11-03T05:30:00Z", "2024-11-03T07:30:00Z", 7200.0), ("2024-11-03T06:30:00Z", "2024-11-03T07:30:00.25Z", 3600.25),
             ("2024-03-10T08:30:00Z", "2024-03-10T09:30:00Z", 3600.0), ("2024-03-31 01:30:00", "2024-03-31 03:30:00", 7200.0),
             ("1969-12-31T23:59:59.5Z", "1970-01-01T00:00:01Z", 1.5)]
    p = write(tmp_path / "m.csv", NAMES, *[ROW | {"ride_id": f"t{i}", "started_at": a, "ended_at": b} for i, (a, b, _) in enumerate(times)])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rides = add_features(CSV.read_rides_csv(spark, p)).orderBy("ride_id")
        got = rides.selectExpr("ride_length", "hour_of_day", "cast(started_at as string) s").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.ride_length for r in got] == [t[2] for t in times]
    assert [r.s[11:16] for r in got] == [t[0][11:16] for t in times]
    assert [r.hour_of_day for r in got] == [int(t[0][11:13]) for t in times]


# ------------------------------------------------------------ undated rides


def undate(row):
    return row[:2] + (None,) + row[3:]


@pytest.mark.parametrize("persist", [True, False], ids=["written", "lazy"])
def test_an_undated_ride_does_not_decide_a_name(spark, persist):
    rows = [
        undate(ride("u1", 0, 300, "B", "Beta", "B", "Old")),
        ride("u2", 5, 300, "B", "Beta", "B", "Beta"),
        ride("u3", 9, 300, "B", "Beta", "B", None),
        # only undated rides: the smallest ride id decides
        undate(ride("u5", 0, 300, "C", "Gamma", "C", "Gamma 5")),
        undate(ride("u4", 0, 300, "C", "Gamma", "C", "Gamma 4")),
        ride("u6", 9, 300, "B", "Beta", "D", None),
    ]
    p = prepare_rides(edge_frame(spark, rows), persist=persist)
    assert {r[0]: r[1] for r in p.end_lookup.collect()} == {"B": "Beta", "C": "Gamma 4"} == brute_lookups(rows)[0]
    assert [r.ride_id for r in p.cleaned.orderBy("ride_id").collect()] == ["u2", "u3"]


@pytest.mark.parametrize("seed", [11, 12])
@pytest.mark.parametrize("persist", [True, False], ids=["written", "lazy"])
def test_random_rides_with_undated_ones(spark, seed, persist):
    rows = [(f"R{i:03d}",) + r[1:] for i, r in enumerate(random_rides(seed))]
    rows = [undate(r) if i % 4 == 0 else r for i, r in enumerate(rows)]
    p = prepare_rides(edge_frame(spark, rows), persist=persist)
    end_lk, start_lk = brute_lookups(rows)
    assert {r[0]: r[1] for r in p.end_lookup.collect()} == end_lk
    assert {r[0]: r[1] for r in p.start_lookup.collect()} == start_lk
    expected = sorted(((r[0], r[4], r[6]) for r in brute_clean(rows)), key=str)
    assert sorted(((r.ride_id, r.start_station_name, r.end_station_name) for r in p.cleaned.collect()), key=str) == expected


# --------------------------------------------------------------- cube, cache


def test_cube_fails_for_a_threshold_or_column_it_does_not_hold(spark):
    rides = add_features(edge_frame(spark))
    cube = ride_cube(rides, short_seconds=30)
    assert rows_of(S.short_rides_summary(cube, 30)) == rows_of(S.short_rides_summary(rides, 30))
    assert rows_of(RP.analysis_summary(cube, 30)) == rows_of(RP.analysis_summary(rides, 30))
    for call in (lambda: S.short_rides_summary(cube).collect(), lambda: RP.analysis_summary(cube, 60).collect()):
        with pytest.raises(Exception, match="ride cube counts rides under 30.0 s, not 60.0"):
            call()
    for fn in (mean_length, max_length):
        with pytest.raises(ValueError, match="ride_length_min"):
            fn(cube, "ride_length_min")


def test_a_replaced_input_is_seen(spark, tmp_path):
    from cadence.plans import catalog

    base = str(tmp_path)
    target = os.path.join(base, "events.parquet")
    shutil.copyfile(f"{SF001}/events.parquet", target)
    small = prepared(spark, base).cleaned.count()
    assert prepared(spark, base) is prepared(spark, base)
    written = ["read_rides_csv", "combine_ride_files", "ingest_ride_files"]
    before = {catalog.queries()[q](spark, base).count() for q in written}
    shutil.copyfile(f"{SF01}/events.parquet", target)
    assert prepared(spark, base).cleaned.count() > 5 * small
    assert {catalog.queries()[q](spark, base).count() for q in written} == {spark.read.parquet(target).count()} != before


def test_release_deletes_what_was_written(spark, tmp_path):
    from cadence.sources.store import delete_table, storage_dir

    base = str(tmp_path / "in")
    os.mkdir(base)
    shutil.copyfile(f"{SF001}/events.parquet", f"{base}/events.parquet")
    p = prepared(spark, base)
    n = p.cleaned.count()
    p.cube.count(), p.variant(fill_start=False).cleaned.count(), p.quartiles.count(), p.matching.count()
    written = list(p.extras["written"])
    assert len(written) >= 7 and all(os.path.isdir(w) for w in written)
    p.release()
    assert not any(os.path.exists(w) for w in written) and not p.extras["written"]
    assert prepared(spark, base) is not p and prepared(spark, base).cleaned.count() == n
    for path in (base, f"{storage_dir(spark)}/cadence-tables", f"{storage_dir(spark)}/cadence-tables/{spark.sparkContext.applicationId}/../x"):
        with pytest.raises(ValueError, match="is not a table"):
            delete_table(spark, path)
    assert os.path.exists(f"{base}/events.parquet")
