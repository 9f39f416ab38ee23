"""Whitening against numpy's own eigensolver and exact integer arithmetic."""

import numpy as np
import pytest

from cadence.llm import queries, whitening
from cadence.llm.whitening import above, intervals, principal, whiten

SF01 = "/root/testdata/sf0.01"


def spectra():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    yield "spread", np.linspace(1, 100, 24), q
    yield "decades", 10.0 ** np.linspace(-9, 6, 24), q
    yield "equal ends", np.r_[np.ones(14), np.full(10, 5.0)], q
    yield "all equal", np.full(24, 3.0), q
    yield "close", 1 + 1e-7 * np.arange(24), q
    yield "rank one", np.r_[np.zeros(23), 9.0], q
    yield "rank three", np.r_[np.zeros(21), 1.0, 1.0, 2.0], q
    yield "diagonal", np.arange(24.0), np.eye(24)


@pytest.mark.parametrize("name, e, q", list(spectra()))
def test_components(name, e, q):
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    got, y = principal(v, 8)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:8]
    top = want[0]
    assert np.abs(got - want).max() <= 1e-12 * top
    assert np.abs(y.T @ y - np.eye(8)).max() < 1e-12
    assert np.abs(v @ y - y * got).max() <= 1e-9 * top


@pytest.mark.parametrize("name, e, q", list(spectra()))
def test_inertia_counts(name, e, q):
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for cut in (-1.0, 0.5, 1.5, 3.7, 50.0, 1e7):
        assert above(v, cut) == (np.linalg.eigvalsh(v) > cut).sum()
    # a matrix without any large diagonal entry takes pairs of rows
    z = np.array([[0.0, 2.0, 0.0], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0]])
    assert above(z, 0.1) == 1 and above(-z, 0.1) == 1 and above(np.zeros((3, 3)), 0.0) == 0


def test_intervals_miss_none():
    e = np.r_[np.ones(3), np.linspace(2, 3, 30)]
    found = intervals(np.diag(e), 8)
    assert sum(k for *_, k in found) >= 8
    for low, high, k in found:
        assert k == ((e > low) & (e <= high)).sum()
    # disjoint, and from above without a gap that holds an eigenvalue
    lowest = min(low for low, _, _ in found)
    assert sum(k for *_, k in found) == (e > lowest).sum()


def check(rows, vectors, components=8):
    """Rows of one length against numpy; ``vectors`` in order of their ids."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dim)]
    c = np.array([[(n * r[i] - s[i]) / n for i in range(dim)] for r in x])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, dim)
    got = np.full((n, k), np.nan)
    for r in rows:
        assert r.n == n
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        if r.whitened is not None:
            got[r.vec_id, r.component - 1] = r.whitened
            assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    assert len(rows) == n * k
    return got, c @ u[:, :k] / np.sqrt(np.where(e[:k] > 1e-12 * max(e.sum(), 1e-300), e[:k], np.nan))


def test_whole_table(spark):
    rows = queries.op11_embedding_whitening(spark, SF01).collect()
    vectors = [r.embedding for r in spark.read.parquet(f"{SF01}/embeddings.parquet").orderBy("vec_id").collect()]
    got, want = check(rows, vectors)
    want *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-10
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10
    assert np.abs(got.T @ got / len(got) - np.eye(8)).max() == pytest.approx(rows[0].identity_error, abs=1e-12)


def test_same_whatever_the_partitions(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    a, b = (sorted(tuple(r)[:6] for r in whiten(v.repartition(k)).collect()) for k in (1, 7))
    assert a == b


def test_unusable_rows_lengths_and_columns(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = rng.standard_normal((30, 3)).tolist()
    rows = [(i, v, "t", 1) for i, v in enumerate(good)]
    rows += [(100, None, "t", 1), (101, [1.0, None, 2.0], None, 1), (102, [nan, 1.0, 2.0], "t", 1), (103, [inf, 1.0, 2.0], "t", 1), (104, [], "t", 1)]
    rows += [(None, [1.0, 2.0], "t", 1), (200, [3.0, -2.0], "t", 1)]
    d = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, Embedding int"))
    out = d.collect()
    got, want = check([r for r in out if r.vec_id is not None and r.vec_id < 100], good)
    want *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-10
    other = [r for r in out if r.vec_id is None or r.vec_id >= 100]
    # two vectors of length two have one component with variance
    assert sorted((str(r.vec_id), r.component, r.n, r.whitened is None) for r in other) == [
        ("200", 1, 2, False), ("200", 2, 2, True), ("None", 1, 2, False), ("None", 2, 2, True)
    ]
    assert d.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_no_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    rows = whiten(spark.createDataFrame([(i, [1.5, 2.5]) for i in range(4)], schema)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(4, 0, None, 0.0, None)} and len(rows) == 8
    assert whiten(spark.createDataFrame([], schema)).count() == 0


def test_sums_stay_exact_for_huge_numbers(spark):
    rows = [(0, [1e300, 3e12]), (1, [-1e300, 5.0]), (2, [0.25, -7e15])]
    v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(2)
    y = [[max(-(2**62), min(2**62, int(np.floor(min(1e30, max(-1e30, c * 1024)))))) for c in r[1]] for r in rows]
    made = {}
    for r in v.mapInArrow(whitening.sum_moments, whitening.SUMS).collect():
        made[r.place] = made.get(r.place, 0) + (r.part << (32 * r.digit))
    assert made == {0: 3, 1: sum(a for a, _ in y), 2: sum(b for _, b in y), 3: sum(a * a for a, _ in y), 4: sum(a * b for a, b in y), 5: sum(b * b for _, b in y)}
    out = whiten(v, 2, "id", "vec").collect()
    assert len(out) == 6 and {r.deviation for r in out} == {None}
