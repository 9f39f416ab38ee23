"""Shared pieces of the training-data operators: column picking by exact name,
shared-folder tables, sizing, shipping of the package to Python workers, and
connected components.

Conventions used by every operator of this package:

* a null text counts as an empty text;
* a document is identified by its id *and* the hash of its text, so repeated
  rows (same id, same text) are one document and each gets the same answer;
  two rows with one id and different texts are two documents;
* a null id is ordered after every other id;
* columns are found by exact name; further columns, also ones whose names only
  differ in case or repeat, do not matter.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadence.sources.store import materialize, storage_dir

#: Ids that are null sort behind every id.
NULL_ID = (1 << 63) - 1

BATCH_ROWS = 2_000
_SHIPPED: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name (the first of repeated ones)."""
    at = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"c{i}_" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}_").alias(n) for i, n in zip(at, names)])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(did, dh, text)``: id with nulls last, hash of the text, text without nulls."""
    d = pick(docs, id_col, text_col).toDF("id", "t")
    text = F.coalesce(F.col("t"), F.lit(""))
    return d.select(
        F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(text).alias("dh"),
        text.alias("text"),
    )


def single_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``(key, text)`` with one long key per document, ordered like ``(id, text
    hash)``, and the table ``(key, did)`` if the key is not the id itself.

    The id is the key unless some id has several texts; then documents get the
    ranks of a range sort of their ids and hashes.
    """
    d = keyed(docs, id_col, text_col)
    # one row per id and a few longs each
    several = d.groupBy("did").agg(F.min("dh").alias("a"), F.max("dh").alias("b")).filter("a <> b")
    if several.isEmpty():
        return d.select(F.col("did").alias("key"), "text"), None
    ranked = hold(d.select("did", "dh").distinct().orderBy("did", "dh").withColumn("at", F.monotonically_increasing_id()), "keys")
    ids = ranked.select("did", "dh", F.col("at").alias("key"))
    return d.join(ids, ["did", "dh"]).select("key", "text"), ids.select("key", "did")


def out_id(col: str = "did") -> Column:
    """The id as it was given."""
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias("doc_id")


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    ship(df.sparkSession)
    return materialize(df, f"llm-{name}")


def small_side(table: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A written table, to be broadcast if its measured size allows it: 8 bytes a
    fixed-width value, strings and arrays by their characters. Larger ones are left to the planner."""
    wide = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c, t in table.dtypes if t == "string" or t.startswith("array")]
    row = sum(wide, F.lit(16 + 8 * len(table.columns)))
    size = table.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= most_bytes else table


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers once per application, as ``--py-files`` would."""
    storage_dir(spark)
    # Arrow batches of whole texts: fewer rows each than Spark's 10,000
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cadence-ship-"), "cadence_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def width(spark: SparkSession) -> int:
    """The session's shuffle width; it follows the input on a sized cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    ).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs: ``(node, root)``,
    root being the smallest node; isolated nodes do not appear.

    Alternates large-star and small-star steps until the edges stay the same.
    Each step takes minima with a pre-aggregated ``groupBy`` and joins them back,
    so a hub's neighbours are never gathered; only a row count and a checksum
    reach the driver.
    """
    e = hold(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        name,
    )
    seen = _signature(e)
    if not seen[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        # large-star: every larger neighbour of u is tied to u's smallest neighbour
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small-star: u and its smaller neighbours are tied to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(down, "a")
        small = (
            tied.select(F.col("b").alias("x"), "m")
            .union(down.select("a", "m"))
            .toDF("a", "b")
            .filter("a <> b")
            .distinct()
        )
        e = hold(small, name)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
