"""Ride sources and sinks."""

from cadence.sources.csv import (  # noqa: F401
    combine_ride_files,
    read_rides_csv,
    read_summary_csv,
    write_rides_csv,
    write_summary_csv,
)
from cadence.sources.events import rides_from_events, load_rides  # noqa: F401
from cadence.sources.parquet import read_rides_parquet, write_rides_parquet  # noqa: F401
from cadence.sources.store import materialize, storage_dir  # noqa: F401
