"""Materialised intermediate tables in the cluster's shared checkpoint folder.

Long lineages (scan -> aggregate -> join -> features) are cut by writing a
Parquet table under ``spark.checkpoint.dir`` and reading it back. A written
table survives executor loss, gives the planner true file sizes (so
size-based broadcast decisions are made on real numbers) and lets later
queries prune columns and push filters into the scan.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def storage_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the setting is absent *and* Spark runs in local mode (tests) is a
    private scratch folder created; on a cluster the setting is required.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="cadence-ckpt-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[app])
    return _LOCAL_FALLBACK[app]


_SHIPPED: set[str] = set()


def ship_module(spark: SparkSession) -> None:
    """Give the package to the Python workers once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-ship-"), "cadence_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location for one materialised table."""
    app = spark.sparkContext.applicationId
    return f"{storage_dir(spark)}/cadence-tables/{app}/{name}-{uuid.uuid4().hex[:12]}"


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table that this application wrote; other paths are refused."""
    own = f"{storage_dir(spark)}/cadence-tables/{spark.sparkContext.applicationId}/"
    if not path.startswith(own) or ".." in path:
        raise ValueError(f"{path} is not a table below {own}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the re-read
    table (same schema, lineage cut). The path is added to ``written``."""
    spark = df.sparkSession
    path = table_path(spark, name)
    if written is not None:
        written.append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    reader = spark.read
    if partition_by:
        # keep partition column types exactly as written (no inference)
        reader = reader.schema(df.schema).option("basePath", path)
    out = reader.parquet(path)
    return out.select(*df.columns)
