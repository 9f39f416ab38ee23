"""Monthly ride files, ingested as they land.

The reference stacks one CSV per month into a single table. Here that step
is a Structured Streaming query over the landing folder: its source lists new
files (paths only, their content is not read), and every micro-batch reads its
files by column name, like the batch reader, and writes them to a folder of the
table that is named by the batch. A batch that is run again after a failure
replaces its own folder, so every file is in the table exactly once. Progress is
tracked in a checkpoint that belongs to the table (a sibling folder unless given).
A file without a mandatory column fails the query; the batch is tried again once
the file is mended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cadence.schema import RIDE_COLUMNS, RIDES
from cadence.sources.csv import read_rides_csv
from cadence.sources.store import table_path


def ingest_checkpoint(table: str) -> str:
    """Default checkpoint of an ingest table: ``_ingest_checkpoint/<table>``
    beside it, the same on every run."""
    base, _, name = table.rstrip("/").rpartition("/")
    return f"{base}/_ingest_checkpoint/{name}" if base else f"_ingest_checkpoint/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Columns of the source that lists files; the content is never asked for.
LISTED = "path string, modificationTime timestamp, length long, content binary"
BATCH = "ingest_batch"


def ride_file_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``(path)`` of the files that land in ``landing`` (a folder or pattern)."""
    reader = spark.readStream.format("binaryFile").schema(LISTED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(landing).select("path")


def start_ride_ingest(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    processing_time: str = "1 minute",
    max_files_per_trigger: int = 1_000,
) -> StreamingQuery:
    """Start the ingest query. ``available_now`` processes every file present
    and stops (a scheduled batch job); otherwise it keeps polling. A micro-batch
    takes ``max_files_per_trigger`` files at most; their paths are what reaches
    the driver.

    A table that was already written by a stream can only be continued with
    that stream's checkpoint: with an unused one Spark would number its batches
    from 0 again and replace the table's, so this raises ``ValueError``.
    """
    table = table.rstrip("/")
    ckpt = checkpoint or ingest_checkpoint(table)
    if _exists(spark, table) and not _exists(spark, f"{ckpt}/offsets"):
        raise ValueError(f"{table} was written under another checkpoint than {ckpt}; its batches would be replaced")

    def land(paths: DataFrame, batch: int) -> None:
        files = [r["path"] for r in paths.collect()]
        if files:
            read_rides_csv(spark, files).write.mode("overwrite").parquet(f"{table}/{BATCH}={batch}")

    writer = ride_file_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(land).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """The rides of an ingest table; no rides if nothing has landed yet."""
    if not _exists(spark, table):
        return spark.createDataFrame([], RIDES)
    return spark.read.schema(RIDES).option("basePath", table).parquet(f"{table.rstrip('/')}/{BATCH}=*").select(*RIDE_COLUMNS)


def ingest_ride_files(spark: SparkSession, landing: str, table: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Ingest all files in ``landing`` into ``table`` (append, exactly once per
    file) and return the table as a batch DataFrame."""
    out = table or table_path(spark, "rides_ingested")
    q = start_ride_ingest(spark, landing, out, checkpoint, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_ingested(spark, out)
