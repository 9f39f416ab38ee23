"""Join helpers: null-safe key matching and size-checked broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound on rows of a side we are willing to ship to every executor.
# Station lookups have one row per station id (thousands), far below it.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def max_broadcast_rows(df: DataFrame) -> int:
    v = df.sparkSession.conf.get("cadence.broadcast.maxRows", None)
    return int(v) if v else DEFAULT_MAX_BROADCAST_ROWS


def broadcast_if_small(small: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast hint only after counting the side.

    ``small`` should be materialised (a written table), so the count reads
    Parquet footers instead of recomputing it. Above the bound no hint is
    given and Spark plans a shuffle join (AQE splits skewed partitions).
    """
    limit = max_rows if max_rows is not None else max_broadcast_rows(small)
    return F.broadcast(small) if small.count() <= limit else small


def semi_join_null_safe(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``'s key column, with a
    null key matching a null key (membership test ``x %in% y``). A semi join
    needs no distinct right side; pass a distinct (and, when counted small,
    broadcast-hinted) frame to keep the build side small."""
    r = right.select(F.col(right_key).alias("__semi_key"))
    return left.join(r, left[left_key].eqNullSafe(r["__semi_key"]), "left_semi")
