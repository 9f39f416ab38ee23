"""Half of the neighbouring cells suffice; labels of any type, clashing columns, single and double precision."""

import numpy as np
import pytest

from cadence.llm import embeddings


def brute(rows, cosine=0.98):
    ids = [r[0] for r in rows]
    links = {i: 0 for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, v, la) in enumerate(rows):
        for j, w, lb in rows[:a]:
            if la is not None and la == lb and v is not None and w is not None and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                n = np.linalg.norm(x) * np.linalg.norm(y)
                if n > 0 and x @ y / n >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in ids}


def made(seed, n=400, dim=24, single=True):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(0, 20)] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.14, 0.2])
        v = v.astype(np.float32).astype(float) if single else v
        rows.append((i, v.tolist(), ["x", "x", "y", None][int(rng.integers(0, 4))]))
    return rows


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("chunk", [4000, 7])
def test_against_all_pairs(spark, monkeypatch, chunk, single):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = made(3 + single, single=single)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<double>, label string, LABEL string, Vec_ID int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == brute(rows)
    assert sum(n for n, _ in got.values()) > 100


def test_every_pair_meets_in_one_cell_of_a_block():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 16))
    x = np.concatenate([x, x + rng.standard_normal(x.shape) * 0.03])
    y = embeddings.rotated(x)
    own = set(zip(*(a.tolist() for a in embeddings.cell_ids(y, 0.98, False))))
    look = set(zip(*(a.tolist() for a in embeddings.cell_ids(y, 0.98, True))))
    cell = {(r, b): c for r, b, c in own}
    assert not look & own
    for b, ((lo, hi), budget) in enumerate(zip(embeddings.blocks(16), embeddings.budgets(16, 0.98))):
        for i in range(80):
            for j in range(i):
                if ((y[i, lo:hi] - y[j, lo:hi]) ** 2).sum() <= budget:
                    same = cell[i, b] == cell[j, b]
                    ways = same + ((i, b, cell[j, b]) in look) + ((j, b, cell[i, b]) in look)
                    assert ways == 1
