"""Rides as Parquet, partitioned by start month.

Converting the monthly CSV files once to Parquet gives later jobs column
pruning, predicate pushdown and month-level partition pruning (a filter on
``ride_month`` lists only the matching folders).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.schema import RIDE_COLUMNS, RIDES

MONTH_COLUMN = "ride_month"  # 'yyyy-MM' of started_at; the folder key


def write_rides_parquet(rides: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rides partitioned by start month. Each task writes at most one
    file per month it holds; no shuffle."""
    (
        rides.withColumn(MONTH_COLUMN, F.date_format("started_at", "yyyy-MM"))
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy(MONTH_COLUMN)
        .parquet(path)
    )


def read_rides_parquet(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Read rides back with the fixed schema; ``months`` ('yyyy-MM') prunes
    folders before any file is opened."""
    schema = T.StructType(list(RIDES.fields) + [T.StructField(MONTH_COLUMN, T.StringType(), True)])
    df = spark.read.schema(schema).option("basePath", path).parquet(path)
    if months:
        df = df.filter(F.col(MONTH_COLUMN).isin(*months))
    return df.select(*RIDE_COLUMNS)
