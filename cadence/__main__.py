"""Run the whole analysis end to end, like the reference's scripts: load the
rides, clean them, write the three summary exports and print the recap.

    python -m cadence --csv /data/trips/*.csv --out /data/out
    python -m cadence --events /root/testdata/sf0.01 --out /tmp/run-x/out

The exports are small (rider type x weekday); the recap is a dozen lines.
Nothing else is collected to the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cadence.operators import summaries as S
from cadence.operators.report import analysis_summary
from cadence.plans.prepare import prepare_rides
from cadence.plans.session import build_session, configure
from cadence.sources.csv import read_rides_csv, write_summary_csv
from cadence.sources.events import load_rides

EXPORTS = {
    "average_ride_length_by_member.csv": S.average_ride_length_by_member,
    "average_ride_length_by_day.csv": S.average_ride_length_by_day,
    "rides_by_day.csv": S.rides_by_day,
}


def run(spark: SparkSession, out: str, csv: list[str] | None = None, events: str | None = None, min_seconds: float = 10) -> list:
    configure(spark)
    rides = read_rides_csv(spark, csv) if csv else load_rides(spark, events)
    prep = prepare_rides(rides, min_seconds=min_seconds)
    for name, fn in EXPORTS.items():
        write_summary_csv(S.calendar_order(fn(prep.cube), "member_casual"), f"{out.rstrip('/')}/{name}")
    return analysis_summary(prep.cube).collect()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cadence", description=__doc__.split("\n\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", nargs="+", help="ride CSV files or folders")
    src.add_argument("--events", help="folder with events.parquet (generated data)")
    ap.add_argument("--out", required=True, help="folder for the exports")
    ap.add_argument("--min-seconds", type=float, default=10)
    ap.add_argument("--master", default=None, help="Spark master (default: the session's)")
    a = ap.parse_args(argv)
    spark = build_session(a.master) if a.master else SparkSession.builder.getOrCreate()
    order = ["Mean ride length", "Max ride length", "Mode day of the week", "Proportional Share of Rides by Member Type",
             "Number of Short Rides by Member Type", "Number of Rides by Rideable Type and Member Type"]
    recap = sorted(run(spark, a.out, a.csv, a.events, a.min_seconds), key=lambda r: (order.index(r["section"]), r["key"]))
    for row in recap:
        print(f"{row['section']}: {row['key'] + ' ' if row['key'] else ''}{row['value']}")


if __name__ == "__main__":
    main()
