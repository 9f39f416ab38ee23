"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors within cosine ``c`` have squared distance ``2 - 2c`` at most. After
a fixed random rotation the coordinates are split into blocks; a block of ``d``
of ``D`` coordinates gets the budget ``(2 - 2c) * d / D``, so every linked pair
keeps within the budget of at least one block. Per block a grid over its first
coordinates is range-joined: a vector is stored in its own cell and looks into
the cells that the ball of its budget reaches. The union of the candidates of
all blocks is verified on the given vectors in double precision; a pair is
counted in its first block within budget only. A vector looks only into cells
behind its own, since the other vector of a pair does the same, and travels in
single precision where that holds it exactly.

Equal vectors of one label are one class, joined once and expanded by counts.
Cells with many vectors are dealt out as a grid of chunks, so no task holds
more than a bounded part of a cell. A task gives link counts and a spanning
forest of its links, never all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components
and vectors without a label have no links and are their own component; labels of
any type are compared as they print; vectors of different lengths never link; repeated rows are one vector; a null id is
ordered last; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import NULL_ID, connected_components, hold, pick, ship, small_side

GRID = 3
#: Cell width in radii of a block's budget.
CELL = 4.0
SLACK = 1e-9
CHUNK = 4_000


def blocks(dim: int, count: int = 8) -> list[tuple[int, int]]:
    k = max(1, min(count, dim // 4))
    edges = [dim * i // k for i in range(k + 1)]
    return list(zip(edges[:-1], edges[1:]))


@lru_cache(8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates; element by element, so that a vector
    gets the same digits in every task."""
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    q, out = rotation(x.shape[1]), np.zeros_like(u)
    for j in range(x.shape[1]):
        out += u[:, j : j + 1] * q[j]
    return out


def budgets(dim: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (b - a) / dim + SLACK for a, b in blocks(dim)]


def cell_ids(y: np.ndarray, cosine: float, look: bool):
    """``(row, block, cell)``: own cells, or with ``look`` all cells in reach behind the own one."""
    dim = y.shape[1]
    rows, bs, cells = [], [], []
    for b, ((lo, hi), budget) in enumerate(zip(blocks(dim), budgets(dim, cosine))):
        r = np.sqrt(budget)
        z = y[:, lo : min(hi, lo + GRID)]
        at = np.arange(len(y))
        name, own = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
        for g in range(z.shape[1]):
            own = own * 4096 + np.floor(z[:, g] / (CELL * r)).astype(np.int64) + 2048
            low = np.floor((z[at, g] - (r if look else 0)) / (CELL * r)).astype(np.int64)
            high = np.floor((z[at, g] + (r if look else 0)) / (CELL * r)).astype(np.int64)
            more = high > low  # a ball is narrower than a cell: two cells at most
            at = np.concatenate([at, at[more]])
            step = np.concatenate([low, high[more]])
            name = np.concatenate([name, name[more]]) * 4096 + step + 2048
        keep = name > own[at] if look else np.ones(len(at), bool)
        rows.append(at[keep])
        bs.append(np.full(keep.sum(), b, np.int32))
        cells.append(name[keep])
    return np.concatenate(rows), np.concatenate(bs), np.concatenate(cells)


PLACED = "label string, dim int, block int, cell long, probe boolean, cid long, n long, vec binary"


def place(cosine: float, light: bool):
    """Classes to rows of the cells that hold or probe them."""

    def run(batches):
        for b in batches:
            values = [np.asarray(v, np.float64) for v in b.column("vec").to_pylist()]
            dims = np.array([len(v) for v in values], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([values[i] for i in at])
                y = rotated(x)
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                raw = [(f if (f == v).all() else v).tobytes() for f, v in zip(short, x)]
                for probe in (False,) if light else (False, True):
                    r, blk, cell = cell_ids(y, cosine, probe)
                    for i in range(0, len(r), 20_000):
                        ri = r[i : i + 20_000]
                        who = pa.array(at[ri])
                        yield pa.RecordBatch.from_arrays(
                            [
                                b.column("label").take(who),
                                pa.array(np.full(len(ri), dim, np.int32)),
                                pa.array(blk[i : i + 20_000]),
                                pa.array(cell[i : i + 20_000]),
                                pa.array(np.full(len(ri), probe)),
                                b.column("cid").take(who),
                                b.column("n").take(who),
                                pa.array([b""] * len(ri) if light else [raw[k] for k in ri], pa.binary()),
                            ],
                            ["label", "dim", "block", "cell", "probe", "cid", "n", "vec"],
                        )

    return run


EMPTY = pd.DataFrame({"cid": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})


def link_cells(cosine: float):
    """Links of a handful of cells of one block: per class the linked vectors and a local root."""
    one = link_cell(cosine)

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        names = g[["cell", "sp", "sq"]].to_numpy(np.int64)
        order = np.lexsort((names[:, 2], names[:, 1], names[:, 0]))
        cut = np.flatnonzero(np.r_[True, (np.diff(names[order], axis=0) != 0).any(axis=1)])
        found = [one(int(key[1]), int(key[2]), g.iloc[order[a:b]]) for a, b in zip(cut, np.append(cut[1:], len(order)))]
        return pd.concat([EMPTY, *(f for f in found if len(f))], ignore_index=True)

    return run


def link_cell(cosine: float):
    """Links of one cell, or of a pair of its chunks."""

    def run(dim: int, b: int, g: pd.DataFrame) -> pd.DataFrame:
        empty = EMPTY
        # what a row does here (0 is stored, 1 asks, 2 both), and whether it comes from another cell
        role, probe = g["role"].to_numpy(np.int64), g["probe"].to_numpy(bool)
        stored, asks = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        if not len(stored) or not len(asks) or len(g) < 2:
            return empty
        x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in g["vec"]]).astype(np.float64)
        y = rotated(x)
        cid, n = g["cid"].to_numpy(np.int64), g["n"].to_numpy(np.int64)
        cut, most = blocks(dim), budgets(dim, cosine)
        lo, hi = cut[b]
        norm = np.sqrt((x * x).sum(axis=1))
        left, right = [], []
        sy = y[stored, lo:hi]
        for i in range(0, len(asks), 512):
            q = asks[i : i + 512]
            qy = y[q, lo:hi]
            d2 = (qy * qy).sum(axis=1)[:, None] + (sy * sy).sum(axis=1)[None, :] - 2 * qy @ sy.T
            # of two vectors of one cell both ask: the smaller one counts
            a, s = np.nonzero((d2 <= most[b] + 1e-6) & (probe[q][:, None] | (cid[q][:, None] < cid[stored][None, :])))
            a, s = q[a], stored[s]
            for j in range(0, len(a), 1 << 16):
                a1, s1 = a[j : j + (1 << 16)], s[j : j + (1 << 16)]
                gap = (y[a1] - y[s1]) ** 2
                first = np.ones(len(a1), bool)
                for k in range(b):
                    first &= gap[:, cut[k][0] : cut[k][1]].sum(axis=1) > most[k]
                first &= gap[:, lo:hi].sum(axis=1) <= most[b]
                a1, s1 = a1[first], s1[first]
                good = (x[a1] * x[s1]).sum(axis=1) / (norm[a1] * norm[s1]) >= cosine
                left.append(a1[good])
                right.append(s1[good])
        if not left or not sum(map(len, left)):
            return empty
        names, inv = np.unique(cid[np.concatenate(left + right)], return_inverse=True)
        ends = np.concatenate(left + right)
        half = len(ends) // 2
        u, v = inv[:half], inv[half:]
        links = np.zeros(len(names), np.int64)
        np.add.at(links, u, n[ends[half:]])
        np.add.at(links, v, n[ends[:half]])
        root = np.arange(len(names))
        while True:
            low = np.minimum(root[u], root[v])
            was = root.copy()
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if (root == was).all():
                break
        return pd.DataFrame({"cid": names, "root": names[root], "links": links})

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    v = pick(vectors, id_col, vec_col, label_col).toDF("id", "vec", "label")
    v = v.select(
        F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("vid"), F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label")
    )
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda c: c != 0)
    good = v.filter(F.coalesce(usable, F.lit(False)))
    once = good.groupBy("label", "vec", "vid").agg(F.count("*").alias("rows"))
    classes = hold(
        once.groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("vid").alias("first")).withColumn("cid", F.monotonically_increasing_id()),
        "vec-classes",
    )
    cells = ["label", "dim", "block", "cell"]
    crowded = (
        classes.mapInArrow(place(cosine, True), PLACED).groupBy(*cells).agg(F.count("*").alias("c")).filter(F.col("c") > CHUNK)
        .select(*cells, F.ceil(F.col("c") / F.lit(CHUNK)).cast("int").alias("s"))
    )
    placed = classes.mapInArrow(place(cosine, False), PLACED)
    # crowded cells are few (rows / CHUNK a block at most), so the placed rows mostly travel once, to their cells
    dealt = placed.join(small_side(hold(crowded, "vec-crowded")), cells, "left").withColumn("s", F.coalesce("s", F.lit(1)))
    mine = F.pmod(F.xxhash64("cid"), F.col("s")).cast("int")
    roles = F.when(F.col("probe"), F.array(F.lit(1))).when(F.col("s") == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    dealt = dealt.withColumn("role", F.explode(roles)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    asking = F.col("role") == 1
    dealt = dealt.withColumn("sp", F.when(asking, F.col("other")).otherwise(mine)).withColumn("sq", F.when(asking, mine).otherwise(F.col("other")))
    # small cells share a task group; a group stays at some thousand rows as the input grows
    handfuls = max(1, classes.count() // CHUNK)
    dealt = dealt.withColumn("handful", F.pmod(F.xxhash64("cell", "sp", "sq"), F.lit(handfuls)))
    local = hold(
        dealt.select(*cells, "handful", "sp", "sq", "role", "probe", "cid", "n", "vec")
        .groupBy("label", "dim", "block", "handful")
        .applyInPandas(link_cells(cosine), "cid long, root long, links long"),
        "vec-links",
    )
    comp = connected_components(local.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vec-components")
    rooted = classes.join(comp, classes.cid == comp.node, "left").select("cid", "first", F.coalesce("root", "cid").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    counted = local.groupBy("cid").agg(F.sum("links").alias("links"))
    named = (
        classes.join(rooted.select("cid", "root"), "cid").join(lowest, "root").join(counted, "cid", "left")
        .select(F.col("label").alias("k_label"), F.col("vec").alias("k_vec"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    )
    out = v.withColumn("ok", F.coalesce(usable, F.lit(False)))
    alone = out.filter("not ok").select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component"))
    joined = out.filter("ok").join(named, (F.col("label") == F.col("k_label")) & (F.col("vec") == F.col("k_vec"))).select("vid", "n_links", "component")
    given = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return joined.union(alone).select(
        given("vid").alias("vec_id"), "n_links", given("component").alias("component_id"), (F.col("vid") == F.col("component")).alias("kept")
    )
