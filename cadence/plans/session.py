"""Session settings for the ride plans.

``configure`` only sets runtime SQL options that are safe to change on a
live session; ``build_session`` creates a session for scripts and tests.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime options every plan here relies on.
RUNTIME_CONF = {
    # Ride times are wall-clock UTC (TIMESTAMP_NTZ); differences and labels
    # must not pass through a zone with daylight-saving gaps.
    "spark.sql.session.timeZone": "UTC",
    # AQE: runtime re-planning, coalescing of small shuffle partitions,
    # splitting of skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shuffle_partitions_for(input_bytes: int, target_partition_bytes: int = 256 << 20, minimum: int = 8, maximum: int = 32768) -> int:
    """Initial shuffle width for an input of ``input_bytes``: about one
    partition per ``target_partition_bytes`` of input, capped at ``maximum``
    (map-output bookkeeping grows with maps x partitions). AQE then coalesces
    the small ones; the regular stages only shuffle partial aggregates, far
    below the input size."""
    return min(maximum, max(minimum, -(-int(input_bytes) // int(target_partition_bytes))))


def cluster_conf(input_bytes: int, executor_cores: int = 4, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large run over ``input_bytes`` of ride files.

    * scan splits of ``target_partition_bytes`` (a task holds one split);
    * initial shuffle width from the input size, AQE coalescing to the same
      advisory size, so no reducer sees more than a few hundred MB;
    * skew split for partitions 5x the median and above 512 MB;
    * a planner broadcast threshold of 64 MB for sides Spark can size itself
      (our own hints are row-count checked, ``cadence.broadcast.maxRows``).
    ``spark.checkpoint.dir`` must name the shared folder for written tables.
    """
    parts = shuffle_partitions_for(input_bytes, target_partition_bytes)
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.executor.cores": str(executor_cores),
    }


def build_session(master: str = "local[8]", app_name: str = "cadence", shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in {**RUNTIME_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
