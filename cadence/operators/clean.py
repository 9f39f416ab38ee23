"""Station-name repair and ride filters.

The station lookups are built from the rides themselves:

* J1: rides whose ``end_station_id`` also occurs as some ride's
  ``start_station_id`` (null matches null);
* per station id, the name on the *first* such ride, ordered by
  ``(started_at, ride_id)`` with undated rides last, even when that name is
  null;
* missing names are filled from the lookup by a left join on the id.

The rides are reduced twice, by keys that only grow with the stations: first to
the distinct start ids, whose (broadcast) semi join finds J1's rides in place;
then J1's rides, each counted for its end and for its start station, to one row
per (side, id, name) with its earliest start. Both aggregations combine inside
the tasks, so a hot station costs nothing extra and the shuffle carries stations
and their names, never pairs of stations. Lookups and conflict reports are
computed on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.joins import semi_join_null_safe
from cadence.schema import REQUIRED_COLUMNS

ROUTE_KEYS = ["end_station_id", "start_station_id", "end_station_name", "start_station_name"]


def _null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def start_station_ids(rides: DataFrame) -> DataFrame:
    """Distinct start ids, the null id included."""
    return rides.select("start_station_id").distinct()


def matched_rides(rides: DataFrame, start_ids: DataFrame) -> DataFrame:
    """Rides whose end id occurs as a start id (J1). ``start_ids`` is distinct;
    hint it with ``broadcast_if_small`` once it is written."""
    return semi_join_null_safe(rides, start_ids, "end_station_id", "start_station_id")


def matching_station_ids(matched: DataFrame) -> DataFrame:
    """J1 result: distinct (end id, start id, end name, start name)."""
    return matched.select(*ROUTE_KEYS).distinct()


def _station_sides(matched: DataFrame, *cols: str) -> DataFrame:
    """Each of J1's rides twice, for its end and its start station: side,
    station_id, station_name, ``cols``."""
    each = [
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_station_id").alias("station_id"), F.col(f"{side}_station_name").alias("station_name"))
        for side in ("end", "start")
    ]
    return matched.select(F.inline(F.array(*each)), *cols)


def station_names(matched: DataFrame) -> DataFrame:
    """One row per distinct (side, station_id, station_name) of J1's rides with
    the start time of its earliest ride. The buffer is a single timestamp, so
    Spark runs a hash aggregate with map-side combine."""
    sides = _station_sides(matched, "started_at")
    return sides.groupBy("side", "station_id", "station_name").agg(F.min("started_at").alias("first_started_at"))


def side_of(names: DataFrame, side: str, *cols: str) -> DataFrame:
    """One side of a (side, station_id, station_name, ...) table, with the side's column names."""
    return names.filter(F.col("side") == side).select(
        F.col("station_id").alias(f"{side}_station_id"), F.col("station_name").alias(f"{side}_station_name"), *cols
    )


def end_station_lookup(names: DataFrame) -> DataFrame:
    """Distinct (end id, end name) of J1's rides, from ``station_names``."""
    return side_of(names, "end")


def start_station_lookup(names: DataFrame) -> DataFrame:
    return side_of(names, "start")


def grouped_filter(df: DataFrame, keys: list[str], min_rows: int = 2) -> DataFrame:
    """Rows whose group (by ``keys``) has at least ``min_rows`` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__group_n", n).filter(F.col("__group_n") >= min_rows).drop("__group_n")


def lookup_conflicts(lookup: DataFrame, id_col: str) -> DataFrame:
    """Lookup rows of ids that carry more than one name (a null name counts)."""
    return grouped_filter(lookup, [id_col]).distinct()


def end_station_lookup_conflicts(names: DataFrame) -> DataFrame:
    return lookup_conflicts(end_station_lookup(names), "end_station_id")


def start_station_lookup_conflicts(names: DataFrame) -> DataFrame:
    return lookup_conflicts(start_station_lookup(names), "start_station_id")


# ---- first name per id, ordered by (started_at, ride_id)
#
# All rides of one (side, id, name) carry the same name, so their earliest
# start time decides the name's place. One aggregation per id takes both the
# smallest and the largest name at the earliest instant; when they differ,
# rides with different names started together and only the ride ids can order
# them. Those few tied names are looked up in the rides by (broadcast) joins
# on id, name and instant, and only if any exist.


def first_names(names: DataFrame) -> DataFrame:
    """Both lookups in one aggregation over ``station_names``: side, station_id,
    station_name, t0 (the earliest instant), tied."""
    # smallest name at the earliest instant, and largest name at the earliest
    # instant (ordering by the time left until a fixed origin); they differ
    # only on a tie. Names without a dated ride come last.
    t = F.col("first_started_at")
    before_origin = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' - first_started_at")
    lo = F.min(F.struct(t.isNull().alias("undated"), t.alias("t"), F.col("station_name").alias("n")))
    hi = F.max(F.struct(t.isNotNull().alias("dated"), before_origin.alias("t"), F.col("station_name").alias("n")))
    agg = names.groupBy("side", "station_id").agg(lo.alias("__lo"), hi.alias("__hi"))
    return agg.select(
        "side",
        "station_id",
        F.col("__lo.n").alias("station_name"),
        F.col("__lo.t").alias("t0"),
        (~F.col("__lo.n").eqNullSafe(F.col("__hi.n"))).alias("tied"),
    )


TIE_KEYS = ["side", "station_id", "station_name", "first_started_at"]


def tied_names(names: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows of ``station_names`` of tied ids at their id's earliest instant."""
    t = firsts.filter("tied").select(F.col("side").alias("__side"), F.col("station_id").alias("__id"), "t0")
    cond = (names["side"] == t["__side"]) & names["station_id"].eqNullSafe(t["__id"]) & names["first_started_at"].eqNullSafe(t["t0"])
    return names.join(t, cond, "left_semi").select(*TIE_KEYS)


def name_tiebreaks(matched: DataFrame, tied: DataFrame) -> DataFrame:
    """Smallest ride id among the rides of each tied name at its earliest
    instant. ``tied`` is small: hint it with ``broadcast_if_small``."""
    sides = _station_sides(matched, F.col("started_at").alias("first_started_at"), "ride_id")
    hits = sides.join(tied, _null_safe_on(sides, tied, TIE_KEYS), "left_semi")
    return hits.groupBy(*TIE_KEYS).agg(F.min("ride_id").alias("first_ride_id"))


def resolve_ties(firsts: DataFrame, tiebreaks: DataFrame) -> DataFrame:
    """``first_names`` with the name of tied ids taken from the ride of the
    smallest ride id (of equal ride ids, the smallest name)."""
    best = tiebreaks.groupBy(F.col("side").alias("__side"), F.col("station_id").alias("__id")).agg(
        F.min_by(F.struct("station_name"), F.struct("first_ride_id", "station_name")).alias("__n")
    )
    j = firsts.join(best, (firsts["side"] == best["__side"]) & firsts["station_id"].eqNullSafe(best["__id"]), "left")
    name = F.when(F.col("tied"), F.col("__n.station_name")).otherwise(F.col("station_name"))
    return j.select("side", "station_id", name.alias("station_name"), "t0", "tied")


def first_names_exact(matched: DataFrame) -> DataFrame:
    """Both lookups as one lazy plan: the exact first ride of each (side, id,
    name) by (started_at, ride_id), then the first name of each id. The ride id
    in the buffer makes the first step a sort-based aggregate; the written path
    uses ``station_names`` and a tie pass instead."""
    order = F.struct(F.col("started_at").isNull().alias("undated"), "started_at", "ride_id")
    sides = _station_sides(matched, order.alias("__first"))
    names = sides.groupBy("side", "station_id", "station_name").agg(F.min("__first").alias("__first"))
    first = F.min_by(F.struct("station_name"), F.struct("__first", "station_name"))
    return names.groupBy("side", "station_id").agg(first.alias("__n")).select("side", "station_id", F.col("__n.station_name").alias("station_name"))


def end_station_lookup_clean(firsts: DataFrame) -> DataFrame:
    """One name per end id, from ``first_names`` (ties resolved) or ``first_names_exact``."""
    return side_of(firsts, "end")


def start_station_lookup_clean(firsts: DataFrame) -> DataFrame:
    return side_of(firsts, "start")


def fill_station_name(rides: DataFrame, lookup: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Left-join ``lookup`` on the id (null-safe) and fill only missing names.

    The lookup has one row per id, so the row count is unchanged. Pass a
    broadcast-hinted lookup (see ``broadcast_if_small``) to keep the ride side
    from shuffling.
    """
    lk = lookup.select(F.col(id_col).alias("__lk_id"), F.col(name_col).alias("__lk_name"))
    joined = rides.join(lk, rides[id_col].eqNullSafe(lk["__lk_id"]), "left")
    return joined.withColumn(name_col, F.coalesce(F.col(name_col), F.col("__lk_name"))).select(*rides.columns)


def fill_end_station_name(rides: DataFrame, end_lookup: DataFrame) -> DataFrame:
    return fill_station_name(rides, end_lookup, "end_station_id", "end_station_name")


def fill_start_station_name(rides: DataFrame, start_lookup: DataFrame) -> DataFrame:
    return fill_station_name(rides, start_lookup, "start_station_id", "start_station_name")


def drop_incomplete_rides(rides: DataFrame) -> DataFrame:
    """Keep rides with all seven required fields; start_station_name may be null."""
    return rides.dropna(how="any", subset=REQUIRED_COLUMNS)


def zero_or_negative_rides(rides: DataFrame, length_col: str = "ride_length") -> DataFrame:
    return rides.filter(F.col(length_col) <= 0)


def drop_nonpositive_rides(rides: DataFrame, length_col: str = "ride_length") -> DataFrame:
    return rides.filter(F.col(length_col) > 0)


def drop_too_short_rides(rides: DataFrame, min_seconds: float = 10, length_col: str = "ride_length") -> DataFrame:
    return rides.filter(F.col(length_col) > min_seconds)


def short_rides(rides: DataFrame, max_seconds: float = 60, length_col: str = "ride_length") -> DataFrame:
    return rides.filter(F.col(length_col) < max_seconds)


def casual_rides(rides: DataFrame) -> DataFrame:
    return rides.filter(F.col("member_casual") == "casual")
