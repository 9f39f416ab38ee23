import os
import tempfile

from cadence.sources import csv as CSV
from cadence.streaming import ingest_ride_files
from tests.fixtures import edge_frame


def test_ingest_monthly_files_once(spark):
    base = tempfile.mkdtemp(prefix="cadence-stream-")
    landing = os.path.join(base, "landing")
    rides = edge_frame(spark)
    CSV.write_rides_csv(rides.filter("ride_id < 'r10'"), os.path.join(landing, "m1"))
    CSV.write_rides_csv(rides.filter("ride_id >= 'r10'"), os.path.join(landing, "m2"))
    table = os.path.join(base, "table")
    ckpt = os.path.join(base, "ckpt")
    got = ingest_ride_files(spark, os.path.join(landing, "*"), table, ckpt)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rides.collect()), key=str)
    # a second run with the same checkpoint picks up nothing new
    again = ingest_ride_files(spark, os.path.join(landing, "*"), table, ckpt)
    assert again.count() == rides.count()
