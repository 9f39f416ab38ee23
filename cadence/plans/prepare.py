"""The cleaning plan, materialised once per input and reused by every summary.

Stages (each a Spark job over the whole input):

1. ``start_ids``: the distinct start station ids, and ``names``: the rides whose
   end id is one of them, reduced to (side, station id, name) with their earliest
   start. Both combine inside the tasks and are written to the shared folder.
2. lookups: first name per end / start station id, derived from ``names``
   (small). Cached, counted, broadcast only below the bounds. Ride ids
   are consulted only for names tied at an id's earliest instant.
3. ``complete``: rides with names filled (broadcast hash joins, the ride side
   never shuffles), incomplete rows dropped, all features added. Written
   once as Parquet; later summaries read only the columns they need and push
   the length filter into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cadence.operators import clean as K
from cadence.operators.chartdata import quartiles
from cadence.operators.cube import cube_of, ride_cube, station_table, stations_of, summary_tables
from cadence.operators.elapsed import unit_for, with_unit
from cadence.operators.features import add_features
from cadence.operators.joins import broadcast_if_small, max_broadcast_rows
from cadence.operators.lengths import length_table
from cadence.operators.summaries import station_utilization
from cadence.sources.events import load_rides
from cadence.sources.store import delete_table, materialize


# tables derived from the cleaned rides, dropped when those change
_DERIVED = ("cube", "stations", "length_table", "length_quartiles", "station_utilization")


@dataclass
class PreparedRides:
    raw: DataFrame
    start_ids: DataFrame
    names: DataFrame
    end_lookup: DataFrame
    start_lookup: DataFrame
    complete: DataFrame
    min_seconds: float = 10
    fill_start: bool = True
    # lookups as they enter the fill joins (broadcast-hinted when counted small)
    end_join: DataFrame | None = None
    start_join: DataFrame | None = None
    extras: dict = field(default_factory=dict)

    def filled_end(self) -> DataFrame:
        """All rides with missing end names filled (no rows dropped)."""
        return K.fill_end_station_name(self.raw, self.end_join if self.end_join is not None else self.end_lookup)

    def filled(self) -> DataFrame:
        """All rides after both fills (or only the end fill)."""
        out = self.filled_end()
        if self.fill_start:
            out = K.fill_start_station_name(out, self.start_join if self.start_join is not None else self.start_lookup)
        return out

    def matched_rides(self) -> DataFrame:
        """J1 over all rides: rides whose end id occurs as a start id."""
        return K.matched_rides(self.raw, self.start_ids)

    @property
    def matching(self) -> DataFrame:
        """``matching_station_ids``: the distinct station pairs of J1's rides with
        their names. Only the queries that show them pay for this table."""
        return self._kept("matching_station_ids", lambda: K.matching_station_ids(self.matched_rides()))

    def variant(self, fill_start: bool) -> "PreparedRides":
        """The same input, names and lookups with the start fill switched
        on or off."""
        other = PreparedRides(
            self.raw, self.start_ids, self.names, self.end_lookup, self.start_lookup, self.raw, self.min_seconds, fill_start,
            self.end_join, self.start_join if fill_start else None, {k: v for k, v in self.extras.items() if k not in _DERIVED},
        )
        if fill_start and other.start_join is None:
            other.start_join = broadcast_if_small(self.start_lookup) if self.extras.get("materialized") else self.start_lookup
        complete = add_features(K.drop_incomplete_rides(other.filled()))
        # the rides differ in one name only: kept as a view behind the (broadcast)
        # lookups, not written a second time
        other.complete = complete
        return other

    def with_min_seconds(self, min_seconds: float) -> "PreparedRides":
        """Same tables with another lower length bound: the complete-ride table
        does not depend on it, only the cleaned view and its summary tables."""
        extras = {k: v for k, v in self.extras.items() if k not in _DERIVED}
        return PreparedRides(
            self.raw, self.start_ids, self.names, self.end_lookup, self.start_lookup, self.complete, min_seconds, self.fill_start,
            self.end_join, self.start_join, extras,
        )

    def release(self) -> None:
        """Drop the cached lookups and delete the tables written for this input, its
        variants' included. The prepared rides cannot be used afterwards; ``prepared``
        builds them anew."""
        for df in self.extras.get("cached", ()):
            df.unpersist()
        written = self.extras.get("written", [])
        for key in [k for k, p in _CACHE.items() if p.extras.get("written") is written]:
            del _CACHE[key]
        while written:
            delete_table(self.raw.sparkSession, written.pop())

    def _summary_tables(self) -> None:
        # one grouping-sets scan of the cleaned rides gives both small tables;
        # written (materialised state) or left lazy
        if self.extras.get("materialized"):
            keep = lambda df, name: materialize(df, name, written=self.extras["written"])
            tables = keep(summary_tables(self.cleaned), "summary_tables")
            self.extras["cube"] = keep(cube_of(tables), "ride_cube")
            self.extras["stations"] = keep(stations_of(tables), "station_table")
        else:
            self.extras["cube"] = ride_cube(self.cleaned)
            self.extras["stations"] = station_table(self.cleaned)

    @property
    def cube(self) -> DataFrame:
        """``ride_cube`` of the cleaned rides (see ``cube``)."""
        if self.extras.get("cube") is None:
            self._summary_tables()
        return self.extras["cube"]

    @property
    def stations(self) -> DataFrame:
        """``station_table`` of the cleaned rides (rides per start / end station
        and rider type)."""
        if self.extras.get("stations") is None:
            self._summary_tables()
        return self.extras["stations"]

    def _kept(self, name: str, build) -> DataFrame:
        if self.extras.get(name) is None:
            df = build()
            self.extras[name] = materialize(df, name, written=self.extras["written"]) if self.extras.get("materialized") else df
        return self.extras[name]

    @property
    def lengths(self) -> DataFrame:
        """``length_table`` of the cleaned rides."""
        return self._kept("length_table", lambda: length_table(self.cleaned))

    @property
    def quartiles(self) -> DataFrame:
        """Length quartiles per rider type."""
        return self._kept("length_quartiles", lambda: quartiles(self.lengths))

    @property
    def utilization(self) -> DataFrame:
        """``station_utilization`` of the cleaned rides, one row per station."""
        return self._kept("station_utilization", lambda: station_utilization(self.cleaned))

    @property
    def cleaned(self) -> DataFrame:
        """Complete rides longer than 0 s and than ``min_seconds``."""
        return K.drop_too_short_rides(K.drop_nonpositive_rides(self.complete), self.min_seconds)


def prepare_rides(
    rides: DataFrame,
    *,
    min_seconds: float = 10,
    fill_start: bool = True,
    persist: bool = True,
) -> PreparedRides:
    """Run (``persist=True``) or just declare (``persist=False``) the cleaning
    plan for ``rides``.

    With ``persist`` the start ids, the station names and the complete rides are
    written to ``spark.checkpoint.dir``; the station lookups (a few thousand rows
    derived from the written names, so a lost block is recomputed cheaply) are
    cached and counted before they are broadcast.
    """
    if persist:
        rides = spread_if_few_partitions(rides)
        written: list[str] = []
        start_ids = broadcast_if_small(materialize(K.start_station_ids(rides), "start_station_ids", written=written))
        matched = K.matched_rides(rides, start_ids)
        names = materialize(K.station_names(matched), "station_names", written=written)
        firsts = K.first_names(names).persist(StorageLevel.MEMORY_AND_DISK)
        # one small job counts rows and ties per side
        stats = {
            r["side"]: (r["n"], r["n_tied"])
            for r in firsts.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if("tied").alias("n_tied")).collect()
        }
        cached = [firsts]
        if any(n_tied for _, n_tied in stats.values()):
            tied = materialize(K.tied_names(names, firsts), "tied_names", written=written)
            breaks = materialize(K.name_tiebreaks(matched, broadcast_if_small(tied)), "name_tiebreaks", written=written)
            firsts = K.resolve_ties(firsts, breaks).persist(StorageLevel.MEMORY_AND_DISK)
            cached.append(firsts)
        prep = PreparedRides(
            rides, start_ids, names, K.end_station_lookup_clean(firsts), K.start_station_lookup_clean(firsts), rides, min_seconds, fill_start
        )
        prep.extras |= {"materialized": True, "firsts": firsts, "cached": cached, "written": written}
        bound = max_broadcast_rows(rides)
        prep.end_join = F.broadcast(prep.end_lookup) if stats.get("end", (0, 0))[0] <= bound else prep.end_lookup
        if fill_start:
            prep.start_join = F.broadcast(prep.start_lookup) if stats.get("start", (0, 0))[0] <= bound else prep.start_lookup
    else:
        start_ids = K.start_station_ids(rides)
        matched = K.matched_rides(rides, start_ids)
        firsts = K.first_names_exact(matched)
        prep = PreparedRides(
            rides, start_ids, K.station_names(matched), K.end_station_lookup_clean(firsts), K.start_station_lookup_clean(firsts),
            rides, min_seconds, fill_start,
        )
    complete = add_features(K.drop_incomplete_rides(prep.filled()))
    if persist:
        # the smallest length decides the unit lengths are shown in; it is found while the rides are written
        least = Observation()
        complete = materialize(complete.observe(least, F.min(F.abs("ride_length")).alias("least")), "complete_rides", written=written)
        complete = with_unit(complete, "ride_length", unit_for(least.get["least"]))
    prep.complete = complete
    return prep


def spread_if_few_partitions(rides: DataFrame, max_splits: int = 2) -> DataFrame:
    """Inputs that arrive as one or two splits (a single unsplittable file, a
    single row group) would run every stage in one or two tasks; they are
    spread round-robin over the cluster's cores first. Any input with more
    splits is left alone: no shuffle is added to a normally split input."""
    cores = rides.sparkSession.sparkContext.defaultParallelism
    n = rides.rdd.getNumPartitions()
    if n <= max_splits and cores > 2 * n:
        return rides.repartition(cores)
    return rides


def clean_rides(rides: DataFrame, min_seconds: float = 10, fill_start: bool = True) -> DataFrame:
    """Fully lazy cleaned rides (one plan, nothing written) for small inputs
    and ad-hoc single queries. Nothing bounds the lookups here, so the planner
    decides the fill joins from estimates; at scale use ``prepare_rides``,
    which writes the route fold, counts the lookups and broadcasts them only
    when small."""
    return prepare_rides(rides, min_seconds=min_seconds, fill_start=fill_start, persist=False).cleaned


_CACHE: dict[tuple, PreparedRides] = {}


def input_version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, file count and modification time of ``path``: three metadata
    calls whatever the number of files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    content = fs.getContentSummary(p)
    return content.getLength(), content.getFileCount(), fs.getFileStatus(p).getModificationTime()


def prepared(spark: SparkSession, sf_dir: str, *, min_seconds: float = 10, fill_start: bool = True) -> PreparedRides:
    """Prepared rides for a data directory, built once per Spark
    application and version of the input."""
    base = sf_dir.rstrip("/")
    source = (base, input_version(spark, f"{base}/events.parquet"))
    key = (spark.sparkContext.applicationId, source, float(min_seconds), fill_start)
    if key not in _CACHE:
        sibling = _CACHE.get(key[:3] + (not fill_start,))
        same_fill = next((v for k, v in _CACHE.items() if k[:2] == key[:2] and k[3] == fill_start), None)
        if same_fill is not None:
            _CACHE[key] = same_fill.with_min_seconds(min_seconds)
        elif sibling is not None:
            _CACHE[key] = sibling.variant(fill_start)
        else:
            _CACHE[key] = prepare_rides(load_rides(spark, sf_dir), min_seconds=min_seconds, fill_start=fill_start)
    return _CACHE[key]
