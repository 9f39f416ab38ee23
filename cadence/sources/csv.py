"""CSV ride files in, CSV summary exports out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from csv import reader
from functools import reduce
from typing import Iterable
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.sources.store import ship_module
from cadence.schema import REQUIRED_COLUMNS, RIDE_COLUMNS, RIDES, STRING_COLUMNS, TIMESTAMP_COLUMNS

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# Columns every ride file must have; the others are null where a file lacks them.
MANDATORY_COLUMNS = ["ride_id", "started_at", "ended_at", "member_casual", *REQUIRED_COLUMNS]


def ride_read_schema() -> T.StructType:
    # Timestamps are parsed as instants so that both '2024-01-01 08:00:00' and
    # '2024-01-01T08:00:00Z' are understood; they are turned into UTC wall-clock
    # TIMESTAMP_NTZ afterwards.
    return T.StructType(
        [T.StructField(f.name, T.TimestampType() if f.name in TIMESTAMP_COLUMNS else f.dataType, True) for f in RIDES]
    )


CSV_READ_OPTIONS = {
    "header": "true",
    "nullValue": "NA",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "timeZone": "UTC",
    "mode": "PERMISSIVE",
}


def normalize_rides(raw: DataFrame) -> DataFrame:
    """Rides as parsed by the CSV reader -> the fixed ride schema: empty and
    ``NA`` strings become null, instants become UTC wall-clock NTZ."""
    cols = []
    for f in RIDES:
        c = F.col(f.name)
        if f.name in STRING_COLUMNS:
            c = F.when((c == "") | (c == "NA"), F.lit(None).cast("string")).otherwise(c)
        elif f.name in TIMESTAMP_COLUMNS:
            # epoch + elapsed microseconds: never passes through the session's
            # local time, where an hour repeats or is missing at clock changes
            c = F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, CAST(unix_micros({f.name}) * 0.000001BD AS DECIMAL(18, 6)))")
        cols.append(c.alias(f.name))
    return raw.select(*cols)


#: Raw line of a record with a cell that does not parse, or with too few or too many cells.
REJECT = "_rejected_line"


#: Up to so many files the driver's file system client reads the header lines, 16 at
#: a time; beyond, one job does.
FEW_FILES = 1_000


def _first_line(spark: SparkSession, file: str) -> str | None:
    """First non-blank line of a file, unpacked if its name says it is compressed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        return line
    finally:
        stream.close()


def _task_first_line(rows):
    """Path and first non-blank line of the one file of a task; the rest of it is not read."""
    for path, line in rows:
        if line.strip():
            yield path, line
            return


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, line)``: the header line of every file under ``paths``, in one job with
    a task per file. A task stops at its header, so only the beginning of a file is read."""
    ship_module(spark)
    one_file_a_task = spark.newSession()
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        one_file_a_task.conf.set(k, str(1 << 50))
    text = one_file_a_task.read.text(paths).select("_metadata.file_path", "value")
    return spark.createDataFrame(text.rdd.mapPartitions(_task_first_line), "file string, line string")


def header_groups(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths by their column names; empty files are left out. One header, the usual
    case, keeps the paths as they were given; files are named one by one only where
    headers differ."""
    files = spark.read.text(paths).inputFiles()
    if len(files) <= FEW_FILES:
        with ThreadPoolExecutor(16) as pool:
            lines = list(pool.map(lambda f: _first_line(spark, f), files))
        found = [(f, x) for f, x in zip(files, lines) if x is not None]
    else:
        named = first_lines(spark, paths)
        lines = [r["line"] for r in named.select("line").distinct().collect()]
        found = [(None, lines[0])] if len(lines) == 1 else [tuple(r) for r in named.toLocalIterator()] if lines else []
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in found:
        groups.setdefault(header_names(line), []).append(unquote(file or ""))
    return {h: list(paths) for h in groups} if len(groups) == 1 else groups


def header_names(line: str) -> tuple[str, ...]:
    """Column names of a header line, trimmed, quotes and a byte order mark removed."""
    return tuple(c.strip() for c in next(reader([line.lstrip("\ufeff")], skipinitialspace=True)))


def _parse_with_header(spark: SparkSession, header: tuple[str, ...], paths: list[str], options: dict[str, str]) -> DataFrame:
    """Files of one header as the CSV reader parses them: the columns of ``ride_read_schema``,
    ``REJECT`` and ``file``."""
    missing = [c for c in MANDATORY_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"ride files without column(s) {missing}: {paths[:3]}")
    types = {f.name: f.dataType for f in ride_read_schema()}
    fields, seen = [], set()
    for i, c in enumerate(header):
        # columns are taken by position here: unknown and repeated names only hold a place
        fields.append(T.StructField(c if c in types and c not in seen else f"_place_{i}", types.get(c, T.StringType()) if c not in seen else T.StringType(), True))
        seen.add(c)
    schema = T.StructType([*fields, T.StructField(REJECT, T.StringType(), True)])
    raw = spark.read.schema(schema).options(**CSV_READ_OPTIONS, columnNameOfCorruptRecord=REJECT, **options).csv(paths)
    absent = {c: F.lit(None).cast(types[c]) for c in RIDE_COLUMNS if c not in header}
    return raw.select("*", F.col("_metadata.file_path").alias("file")).withColumns(absent)


def _parsed(spark: SparkSession, paths: str | Iterable[str], **options: str) -> list[tuple[tuple[str, ...], DataFrame]]:
    path_list = [paths] if isinstance(paths, str) else list(paths)
    if not path_list:
        return []
    return [(h, _parse_with_header(spark, h, ps, options)) for h, ps in sorted(header_groups(spark, path_list).items())]


def read_rides_csv(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Read one or many ride CSV files, folders or patterns (header row) by column name.

    Empty cells, quoted empty cells and ``NA`` are null; cells are trimmed;
    timestamps without a zone are read as UTC. Columns may come in any order,
    also from file to file, and extra ones are ignored; a missing mandatory
    column raises ``ValueError``, a missing other one is null. The header line of
    every file is read first (see ``header_groups``); files of one header are one
    multi-path read. Cells that do not parse are null here; ``ride_problems`` lists
    them.
    """
    parts = [normalize_rides(raw) for _, raw in _parsed(spark, paths)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RIDES)


PROBLEMS = "file string, line string, column string, expected string, actual string"


def ride_problems(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """``(file, line, column, expected, actual)``: every cell that ``read_rides_csv``
    could not parse and made null, with its raw line, and lines with another number
    of cells than their header (``column`` null)."""
    parts = []
    # whole lines are parsed, or the reader would not count their cells
    for header, raw in _parsed(spark, paths, columnPruning="false"):
        names = raw.columns[: len(header)]
        typed = [f for f in ride_read_schema() if f.name in names and not isinstance(f.dataType, T.StringType)]
        # the cells of a rejected line once more as text, with places for surplus ones
        places = [*names, *[f"_surplus_{i}" for i in range(4)]]
        options = {k: v for k, v in CSV_READ_OPTIONS.items() if k != "header"}
        cells = F.from_csv(F.col(REJECT), ", ".join(f"`{c}` string" for c in places), options)
        # all typed columns are named here, so that every one of them is parsed whatever else is asked for
        bad = raw.select("file", REJECT, *[f.name for f in typed]).filter(F.col(REJECT).isNotNull()).withColumn("cells", cells)
        of = [
            F.when(
                F.col(f.name).isNull() & F.col(f"cells.{f.name}").isNotNull() & (F.col(f"cells.{f.name}") != ""),
                F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("expected"), F.col(f"cells.{f.name}").alias("actual")),
            )
            for f in typed
        ]
        whole = F.struct(F.lit(None).cast("string").alias("column"), F.lit(f"{len(header)} cells").alias("expected"), F.lit("another number of cells").alias("actual"))
        found = F.filter(F.array(*of), lambda x: x.isNotNull())
        parts.append(
            bad.select("file", F.col(REJECT).alias("line"), found.alias("found"))
            .select("file", "line", F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(whole))))
        )
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PROBLEMS)


def read_rides_checked(spark: SparkSession, paths: str | Iterable[str], rejects: str, max_problems: int | None = None) -> tuple[DataFrame, int]:
    """The rides and the number of problems, which are written to the Parquet table
    ``rejects``. More than ``max_problems`` raise ``ValueError`` (the table stays)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    ride_problems(spark, paths).write.mode("overwrite").parquet(rejects)
    n = spark.read.parquet(rejects).count()
    if max_problems is not None and n > max_problems:
        raise ValueError(f"{n} cells or lines could not be read (at most {max_problems} allowed); see {rejects}")
    return read_rides_csv(spark, paths), n


def combine_ride_files(parts: Iterable[DataFrame] | Iterable[str], spark: SparkSession | None = None) -> DataFrame:
    """Stack monthly ride data into one frame.

    Given file or folder paths or patterns, this is one multi-path CSV read per
    distinct header (see ``read_rides_csv``). Given DataFrames, they are stacked by
    column name; columns missing in a frame are null.
    """
    items = list(parts)
    if items and isinstance(items[0], str):
        if spark is None:
            raise ValueError("pass spark to combine files by path")
        return read_rides_csv(spark, items)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), items)


def write_rides_csv(rides: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write rides as CSV with header; nulls as ``NA``; microsecond timestamps."""
    w = (
        rides.write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "NA")
        .option("timestampNTZFormat", TIMESTAMP_TEXT)
        .option("timestampFormat", TIMESTAMP_TEXT)
    )
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


#: Rows that ``write_summary_csv`` takes for one file.
MAX_SUMMARY_ROWS = 1_000_000


def write_summary_csv(summary: DataFrame, path: str, single_file: bool = True) -> None:
    """Export a summary table as CSV with header, nulls written as ``NA``.

    With ``single_file`` the result is one plain file at ``path``: the part file of a
    folder written beside it, renamed at the end; what was at ``path`` before is
    replaced. Meant for the bounded summaries: a frame of more than
    ``MAX_SUMMARY_ROWS`` rows raises ``ValueError``. Otherwise ``path`` becomes a folder
    of part files.
    """
    spark = summary.sparkSession
    if single_file and summary.limit(MAX_SUMMARY_ROWS + 1).count() > MAX_SUMMARY_ROWS:
        raise ValueError(f"over {MAX_SUMMARY_ROWS} rows are not a summary; write {path} as a folder (single_file=False)")
    folder = f"{path.rstrip('/')}-{uuid4().hex[:12]}" if single_file else path
    (
        (summary.coalesce(1) if single_file else summary).write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "NA")
        .option("timestampNTZFormat", TIMESTAMP_TEXT)
        .csv(folder)
    )
    if not single_file:
        return
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.globStatus(at(f"{folder}/part-*"))]
    if len(parts) != 1:
        raise RuntimeError(f"{folder} holds {len(parts)} part files instead of one")
    fs.delete(at(path), True)
    if not fs.rename(parts[0], at(path)):
        raise RuntimeError(f"{parts[0].toString()} could not be renamed to {path}")
    fs.delete(at(folder), True)


def read_summary_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read an exported summary back with a fixed schema (StructType or DDL)."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
