"""cadence: bike-share ride analytics on Spark DataFrames.

Pipeline: a ride source (CSV files or the ``events`` adapter) -> station-name
repair -> completeness filter -> derived features -> length filters -> named
summaries. Every summary is a lazy ``DataFrame``; nothing is collected here.

    from cadence import read_rides_csv, prepare_rides
    from cadence.operators import summaries, ranking
"""

from cadence.plans.prepare import PreparedRides, clean_rides, prepare_rides, prepared  # noqa: F401
from cadence.schema import DAY_NAMES, MONTH_ABBREVIATIONS, RIDES  # noqa: F401
from cadence.sources import (  # noqa: F401
    combine_ride_files,
    read_rides_csv,
    read_rides_parquet,
    rides_from_events,
    write_rides_csv,
    write_rides_parquet,
    write_summary_csv,
)

__all__ = [
    "RIDES",
    "DAY_NAMES",
    "MONTH_ABBREVIATIONS",
    "PreparedRides",
    "prepare_rides",
    "prepared",
    "clean_rides",
    "read_rides_csv",
    "combine_ride_files",
    "write_rides_csv",
    "write_summary_csv",
    "read_rides_parquet",
    "write_rides_parquet",
    "rides_from_events",
]
