"""Adapter: one ride per row of the generated ``events`` table.

The mapping is a fixed rule so that the ride data grows with the input table
(one ride per event) and exercises every cleaning case: missing ids and names
on different rows, stations with two names, rides of negative, zero, sub-10 s
and sub-minute length, twelve months, all hours and weekdays, and a few
casual ride ids that repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.schema import RIDE_COLUMNS


def _station(n: Column) -> Column:
    return F.concat(F.lit("Station "), n.cast("string"))


def rides_from_events(events: DataFrame) -> DataFrame:
    """Map ``events(event_id, ts, user_id, event_type, value, props)`` to the
    ride schema. Pure projection: no shuffle, all columns computed in one
    whole-stage-codegen span."""
    eid = F.col("event_id")
    uid = F.col("user_id")
    end_n = (uid * 7 + eid) % 160
    start = F.col("ts") + F.make_dt_interval(days=(eid % 12) * 30)
    length = F.make_dt_interval(secs=(F.floor(F.col("value") * 30) - 5).cast("int"))
    base_lat = F.lit(41.65).cast("double")
    base_lng = F.lit(-87.80).cast("double")
    step = F.lit(0.01).cast("double")
    end_missing = eid % 211 == 0
    cols = {
        "ride_id": F.concat(F.lit("R"), F.when(eid % 100 == 99, eid % 1000).otherwise(eid).cast("string")),
        "rideable_type": F.when((eid % 100 >= 65) & (eid % 23 == 0), F.lit("docked_bike"))
        .when(F.col("event_type").isin("view", "click", "signup"), F.lit("classic_bike"))
        .otherwise(F.lit("electric_bike")),
        "started_at": start,
        "ended_at": start + length,
        "start_station_name": F.when(eid % 17 == 0, F.lit(None).cast("string"))
        .when(eid % 41 == 0, F.concat(_station(uid), F.lit(" (Temp)")))
        .otherwise(_station(uid)),
        "start_station_id": F.when(eid % 51 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("S"), uid.cast("string"))
        ),
        "end_station_name": F.when(eid % 19 == 0, F.lit(None).cast("string")).otherwise(_station(end_n)),
        "end_station_id": F.when(eid % 57 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("S"), end_n.cast("string"))
        ),
        "start_lat": base_lat + (uid % 40) * step,
        "start_lng": base_lng + (uid % 25) * step,
        "end_lat": F.when(end_missing, F.lit(None).cast("double")).otherwise(base_lat + ((uid * 7 + eid) % 40) * step),
        "end_lng": F.when(end_missing, F.lit(None).cast("double")).otherwise(base_lng + ((uid * 7 + eid) % 25) * step),
        "member_casual": F.when(eid % 100 < 65, F.lit("member")).otherwise(F.lit("casual")),
    }
    return events.select(*[cols[c].alias(c) for c in RIDE_COLUMNS])


def load_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides for a generated data directory (``<sf_dir>/events.parquet``)."""
    return rides_from_events(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"))
