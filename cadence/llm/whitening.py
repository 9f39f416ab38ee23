"""Embedding whitening by contour integration (the FEAST eigensolver).

Components are scaled to longs ``x = floor(1024 * c) + 100000``. Spark sums ``n``,
``S`` and the products of all pairs of dimensions exactly, whatever the
partitioning: a task multiplies blocks of its rows and hands on one number per
pair of dimensions. From these the covariance ``V`` follows without rounding
before its last digit. ``V`` is as wide as a vector and does not grow with the
rows, so its spectrum is found on the driver:

* inertia counts (signs of the pivots of ``V - s*I`` by symmetric elimination)
  tell how many eigenvalues lie above ``s``; bisection by them cuts the upper end
  of the spectrum into intervals that hold few eigenvalues each;
* per interval, Gauss-Legendre quadrature of the complex shifted solves
  ``(z*I - V)^-1 Y`` on a circle around it projects a block ``Y`` onto the interval's
  eigenvectors; Rayleigh-Ritz on the projected block extracts components, and
  the step is repeated until the residuals are at rounding level;
* an interval is done only if it gave as many components as the inertia counts say.

The rows are then centred exactly, projected and scaled in Spark. ``identity_error``
is measured on the whitened rows by Spark's own covariance aggregates.

Defined cases: rows whose vector is null or holds null or non-finite entries are
dropped; vectors of each length are fitted and whitened on their own (an empty
vector has no components); repeated rows are rows; a null id stays null;
``floor(1024 * c)`` is held within 2^62 either way; a component without variance
(fewer different vectors than components) has ``whitened`` null and ``explained`` 0
and takes no part in ``identity_error``, which is null if none has any;
``deviation`` is null where it passes a long; an empty table gives an empty
result; further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import hold, pick, ship

SHIFT = 100_000
STEPS = 1024
HELD = float(1 << 62)
#: Numbers are carried between tasks in digits of 32 bits.
DIGIT = 32
#: Quadrature points on a half circle, and eigenvalues that an interval may hold.
POINTS, PER_INTERVAL = 8, 6
ROUNDS = 40

SUMS = "dim int, place long, digit int, part long"


def scaled(values: np.ndarray) -> np.ndarray:
    """``floor(1024 * c)`` as longs; the shift is left out, as it cancels in every centred number."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * STEPS), -HELD, HELD).astype(np.int64)


def by_length(batch: pa.RecordBatch):
    """Rows of a batch by the length of their vectors: ``(length, row numbers, scaled values)``."""
    col = batch.column("vec")
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    ends = np.cumsum(np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64))
    sizes = np.diff(ends, prepend=0)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, scaled(flat[(ends[at] - dim)[:, None] + np.arange(dim)])


def products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` without rounding, as Python integers where longs could overflow."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if most * most * max(1, len(y)) < 1 << 62:
        return y.T @ y
    z = y.astype(object)
    return z.T @ z


def sum_moments(batches):
    """Per length: at place 0 the rows, then the sums, then the products (upper triangle), in digits."""
    held: dict[int, list] = {}
    for b in batches:
        for dim, _, y in by_length(b):
            n, s, g = held.setdefault(dim, [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
            held[dim] = [n + len(y), s + y.astype(object).sum(axis=0), g + products(y).astype(object)]
    for dim, (n, s, g) in held.items():
        numbers = [n, *s, *g[np.triu_indices(dim)]]
        place, digit, part = [], [], []
        for i, v in enumerate(map(int, numbers)):
            k = 0
            while v >> DIGIT not in (0, -1):
                place.append(i), digit.append(k), part.append(v & ((1 << DIGIT) - 1))
                v, k = v >> DIGIT, k + 1
            place.append(i), digit.append(k), part.append(v)
        for a in range(0, len(place), 50_000):
            some = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(place[some]), pa.int32()), pa.array(place[some], pa.int64()), pa.array(digit[some], pa.int32()), pa.array(part[some], pa.int64())],
                ["dim", "place", "digit", "part"],
            )


def covariance(n: int, s: list[int], g: list[int], dim: int) -> np.ndarray:
    """``(n * sum(xy) - sum(x) sum(y)) / n^2``, each entry rounded once."""
    v = np.zeros((dim, dim))
    for (i, j), p in zip(zip(*np.triu_indices(dim)), g):
        v[i, j] = v[j, i] = (n * p - s[i] * s[j]) / (n * n)
    return v


def above(v: np.ndarray, cut: float) -> int:
    """How many eigenvalues of ``v`` exceed ``cut``: positive pivots of ``v - cut*I`` (Sylvester's law).

    Symmetric elimination with diagonal pivots, and a pair of rows at once where
    every diagonal entry is small against the entries beside it; such a pair has
    one positive and one negative eigenvalue.
    """
    a = v - cut * np.eye(len(v))
    positive = 0
    while len(a):
        d = np.abs(np.diag(a))
        k = int(d.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        if d[k] >= 0.6404 * off.max(initial=0.0):
            if d[k] == 0:
                return positive  # what is left is zero
            positive += a[k, k] > 0
            rest = np.delete(np.arange(len(a)), k)
            c = a[rest, k]
            a = a[np.ix_(rest, rest)] - np.outer(c, c) / a[k, k]
        else:
            i, j = np.unravel_index(int(off.argmax()), off.shape)
            two = a[np.ix_([i, j], [i, j])]
            positive += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            c = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(two, c.T)
    return positive


def intervals(v: np.ndarray, count: int) -> list[tuple[float, float, int]]:
    """Disjoint ``(low, high, eigenvalues inside)`` from above that hold the ``count`` largest at least.

    An interval is halved while it holds more than ``PER_INTERVAL`` and is wider
    than rounding allows to tell apart.
    """
    top = float(np.abs(v).sum(axis=1).max())  # no eigenvalue lies beyond the largest row sum
    top, floor = top * (1 + 1e-12), -1e-12 * top
    counts: dict[float, int] = {}

    def over(cut: float) -> int:
        if cut not in counts:
            counts[cut] = above(v, cut)
        return counts[cut]

    found, open_ = [], [(floor, top)]
    while open_ and sum(k for _, _, k in found) < count:
        low, high = open_.pop()
        inside = over(low) - over(high)
        if inside > PER_INTERVAL and high - low > 1e-10 * top:
            mid = (low + high) / 2
            open_ += [(low, mid), (mid, high)]
        elif inside:
            found.append((low, high, inside))
    return found


def feast(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenpairs of ``v`` in ``(low, high]``, falling."""
    dim = len(v)
    width = min(dim, 2 * inside + 4)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (low + high) / 2, (high - low) / 2
    angle = np.pi / 2 * (nodes + 1)
    shifts = centre + radius * np.exp(1j * angle)
    inverse = [np.linalg.inv(z * np.eye(dim) - v) for z in shifts]
    y = np.random.default_rng(11).standard_normal((dim, width))
    scale = np.abs(v).max()
    rest = np.inf
    best = None
    for _ in range(ROUNDS):
        # the lower half circle is the conjugate of the upper one
        q = sum((w * radius / 2 * np.exp(1j * t) * (r @ y)).real for w, t, r in zip(weights, angle, inverse))
        q, _ = np.linalg.qr(q)
        q, _ = np.linalg.qr(q)
        e, u = np.linalg.eigh(q.T @ v @ q)
        y = q @ u
        # the Ritz values in the interval; at its ends rounding may push one out, so the nearest count
        away = np.maximum(np.maximum(low - e, e - high), 0)
        at = np.sort(np.argsort(away, kind="stable")[:inside])[::-1]
        now = float(np.abs(v @ y[:, at] - y[:, at] * e[at]).max())
        if now < rest:
            rest, best = now, (e[at], y[:, at], float(away[at].max()))
        elif rest <= 1e-11 * scale:
            break
    e, y, out = best
    if rest > 1e-9 * scale or out > 1e-9 * scale:
        raise ArithmeticError(f"interval ({low}, {high}] should hold {inside} components; residual {rest}, {out} beyond its ends")
    return e, y


def principal(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    count = min(count, len(v))
    if not np.abs(v).max():
        return np.zeros(count), np.eye(len(v))[:, :count]
    pairs = [feast(v, *i) for i in intervals(v, count)]
    e, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs], axis=1)
    # intervals are disjoint, yet those of close eigenvalues are told apart only to rounding: settle them together
    q, _ = np.linalg.qr(y)
    e, u = np.linalg.eigh(q.T @ v @ q)
    y = (q @ u)[:, ::-1][:, :count]
    y *= np.where(y[np.abs(y).argmax(axis=0), np.arange(count)] < 0, -1.0, 1.0)
    return e[::-1][:count], y


def fit(vectors: DataFrame, components: int) -> dict[int, dict]:
    """Per length of ``vec``: exact ``n`` and sums, eigenvalues, projection, shares of the variance."""
    rows = vectors.mapInArrow(sum_moments, SUMS).groupBy("dim", "place", "digit").agg(F.sum("part").alias("part")).collect()
    numbers: dict[int, dict[int, int]] = {}
    for r in rows:
        of = numbers.setdefault(r["dim"], {})
        of[r["place"]] = of.get(r["place"], 0) + (r["part"] << (DIGIT * r["digit"]))
    models = {}
    for dim, of in numbers.items():
        n, s, g = of[0], [of[1 + i] for i in range(dim)], [of[1 + dim + i] for i in range(dim * (dim + 1) // 2)]
        v = covariance(n, s, g, dim)
        # a power of two, so that scaling rounds nothing
        unit = 2.0 ** np.floor(np.log2(np.abs(v).max())) if v.any() else 1.0
        e, y = principal(v / unit, components)
        e, trace = e * unit, float(np.trace(v))
        good = e > 1e-12 * trace
        models[dim] = {
            "n": n, "sums": s, "good": good, "axes": y / np.sqrt(np.where(good, e, 1.0)), "explained": np.where(good, e / trace if trace else 0.0, 0.0),
        }
    return models


PROJECTED = "vec_id long, dim int, deviation long, w array<double>"


def project(models: dict[int, dict]):
    """Whitened coordinates and exact deviations of the rows of a task."""

    def run(batches):
        for b in batches:
            ids = b.column("id")
            for dim, at, y in by_length(b):
                m = models[dim]
                n, s = m["n"], np.array(m["sums"], object)
                most = int(np.abs(y).max(initial=0)) * n + max(map(abs, m["sums"]))
                wide = most >= 1 << 62
                gap = y.astype(object) * n - s if wide else y * n - s.astype(np.int64)
                about = (gap.astype(np.float64) ** 2).sum(axis=1)
                deviation = [int(sum(int(v) ** 2 for v in g)) if a < 1e19 else None for g, a in zip(gap, about)] if wide or about.max() >= 2.0**62 else (gap * gap).sum(axis=1).tolist()
                deviation = [d if d is not None and d < 1 << 63 else None for d in deviation]
                centred = (gap / n).astype(np.float64)
                w = np.zeros((len(at), len(m["good"])))
                for j in range(dim):  # element by element, so that a vector gets the same digits in every task
                    w += centred[:, j : j + 1] * m["axes"][j]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at)),
                        pa.array(np.full(len(at), dim, np.int32)),
                        pa.array(deviation, pa.int64()),
                        pa.array([[x if ok else None for x, ok in zip(r, m["good"])] for r in w.tolist()], pa.list_(pa.float64())),
                    ],
                    ["vec_id", "dim", "deviation", "w"],
                )

    return run


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per usable row and component."""
    spark = vectors.sparkSession
    ship(spark)
    v = pick(vectors, id_col, vec_col).toDF("id", "vec")
    v = v.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.filter(F.coalesce(fine, F.lit(False)))
    models = fit(v, components)
    done = hold(v.mapInArrow(project(models), PROJECTED), "whitened")
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    at = lambda i: F.get("w", F.lit(i))
    off = [F.abs(F.covar_pop(at(i), at(j)) - (1.0 if i == j else 0.0)) for i, j in pairs]
    error = off[0] if len(off) == 1 else F.greatest(*off)
    errors = {r["dim"]: r["e"] for r in done.groupBy("dim").agg(error.alias("e")).collect()}
    # a row for each length and component: as bounded as the fitted models themselves
    facts = [
        (dim, k, m["n"], float(m["explained"][k]), errors.get(dim)) for dim, m in models.items() for k in range(len(m["good"]))
    ]
    table = spark.createDataFrame(facts, "dim int, at int, n long, explained double, identity_error double")
    out = done.select("vec_id", "dim", "deviation", F.posexplode("w").alias("at", "whitened")).join(F.broadcast(table), ["dim", "at"])
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error")
