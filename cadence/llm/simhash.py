"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are majority votes over the XXH64 hashes of word shingles. For
radius ``r`` the 64 bits are dealt to the non-zero vectors of GF(2)^(r+1); the
mask of a non-zero vector ``v`` keeps the bits whose vector has an odd product
with ``v``. At most ``r`` differing bits span at most ``r`` dimensions, so some
``v`` is orthogonal to all of them and its mask keeps none: every pair within
the radius agrees on at least one of the ``2**(r+1) - 1`` masked values.

Only distinct fingerprints are linked. Buckets over ``bound`` fingerprints are
split by the same construction over the bits their mask leaves free; distinct
fingerprints that agree on all but ``f`` bits number at most ``2**f``, so every
bucket ends below a fixed size and no pair is lost. A bucket yields a spanning
forest of its links, never all pairs.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; fewer words than a shingle make one shingle; repeated rows share a
component; ties of the smallest id cannot arise beyond equal rows; a null id is
ordered last; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import connected_components, hold, keyed, out_id, ship
from cadence.llm.textnp import text_bytes

SEED = 42
FINGERPRINTS = "did long, dh long, fp long"


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the shingle hashes; text is UTF-8."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), seed=SEED)
    joined = b" ".join(w)
    end = np.cumsum([len(x) + 1 for x in w]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hs = [digest(joined[a:b], seed=SEED) for a, b in zip(start[: len(w) - shingle + 1].tolist(), end[shingle - 1 :].tolist())]
    h = np.array(hs, "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * votes > len(h))))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(did, dh, fp)`` for every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            off, data = text_bytes(b.column("text"))
            fps = [fingerprint(data[i:j].tobytes(), shingle) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("dh"), fp], ["did", "dh", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, FINGERPRINTS)


@lru_cache(None)
def covering_masks(free: int, radius: int) -> tuple[int, ...]:
    """For each non-zero vector the kept bits among the set bits of ``free``."""
    bits = [b for b in range(64) if free >> b & 1]
    top = 1 << (radius + 1)
    vector = {b: 1 + i % (top - 1) for i, b in enumerate(bits)}
    return tuple(sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, top))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning stars ``(fp, smallest fp)`` of the links inside one bucket."""
    n = len(fps)
    x = np.sort(fps).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    root, out, left = np.arange(n), [], np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        seen, edge = np.zeros(n, bool), np.zeros(n, bool)
        seen[i] = edge[i] = True
        while edge.any():
            reach = near[edge].any(axis=0) & ~seen
            seen |= reach
            edge = reach
        left &= ~seen
        root[seen] = i
    signed = x.view(np.int64)
    for k in np.flatnonzero(root != np.arange(n)):
        out.append((int(signed[k]), int(signed[root[k]])))
    return out


def links(distinct_fps: DataFrame, radius: int = 3, bound: int = 256) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints ``fp`` reachable
    through pairs within ``radius`` bits. ``distinct_fps`` has distinct rows."""
    spark = distinct_fps.sparkSession
    ship(spark)
    everything = (1 << 64) - 1
    level = distinct_fps.select("fp", F.lit(0).cast("long").alias("mask"))
    masks, found = {0}, None

    def pairs(batches):
        for b in batches:
            rows = [bucket_links(np.asarray(v, np.int64), radius) for v in b.column("fps").to_pylist()]
            flat = [e for r in rows for e in r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in flat], pa.int64()), pa.array([e[1] for e in flat], pa.int64())], ["a", "b"]
            )

    while True:
        # at most 15, 225, 3375 ... rows by the radius and the level, whatever the input
        table = [(_signed(m), _signed(m | s)) for m in masks for s in set(covering_masks(everything & ~m, radius))]
        if masks == {0}:
            rows = level.select("fp", F.explode(F.array(*[F.lit(to) for _, to in table])).alias("mask"))
        else:
            steps = spark.createDataFrame(table, "mask long, next long")
            rows = level.join(F.broadcast(steps), "mask").select("fp", F.col("next").alias("mask")).distinct()
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        shared = hold(rows.join(sizes, ["mask", "key"]), "simhash-buckets")
        masks = {m & everything for _, m in table}
        small = shared.filter(F.col("n") <= bound)
        groups = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        edges = groups.mapInArrow(pairs, "a long, b long").distinct()
        found = edges if found is None else found.union(edges)
        large = shared.filter(F.col("n") > bound)
        left = {r["mask"] & everything for r in large.select("mask").distinct().collect()}
        if not left:
            return found
        masks = left
        level = large.select("fp", "mask")
        # a mask with few free bits bounds its buckets by itself
        bound = max(bound, 1 << min((64 - min(m.bit_count() for m in masks)) // 2, 12))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(did, dh, fp, component_did)``: the smallest id reachable, per row."""
    prints = hold(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    distinct = hold(prints.groupBy("fp").agg(F.min("did").alias("first_did"), F.min(F.struct("did", "dh")).alias("first")), "simhash-distinct")
    comp = connected_components(links(distinct.select("fp"), radius), "simhash-components")
    rooted = distinct.join(comp, distinct.fp == comp.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    named = rooted.join(lowest, "root").select("fp", "lowest")
    return prints.join(named, "fp").select("did", "dh", "fp", "lowest")


def representatives(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the smallest id. Rows that
    repeat one document (same id and text) count as copies: one row stays."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    ident, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    best = near_duplicates(docs, shingle, radius, id_col, text_col)
    stay = best.filter((F.col("did") == F.col("lowest.did")) & (F.col("dh") == F.col("lowest.dh"))).select("did", "dh").distinct()
    mine = flat.withColumn("sim_did", F.coalesce(ident.cast("long"), F.lit((1 << 63) - 1))).withColumn(
        "sim_dh", F.xxhash64(F.coalesce(text, F.lit("")))
    )
    kept = mine.join(stay, (F.col("sim_did") == F.col("did")) & (F.col("sim_dh") == F.col("dh")), "left_semi")
    return kept.dropDuplicates(["sim_did", "sim_dh"]).select(*names).toDF(*docs.columns)


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row."""
    d = near_duplicates(docs, **options)
    return d.select(
        out_id(),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        out_id("lowest.did").alias("component_id"),
    )
