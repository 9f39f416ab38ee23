"""Expectation-maximisation and the linear fit on problems small enough to check by hand."""

import itertools

import numpy as np

from cadence.llm import quality


def log_likelihood(v, has, counts, rates, prior):
    r = np.clip(rates, 1e-3, 1 - 1e-3)
    part = [np.prod(np.where(has, np.where(v > 0, r[k], 1 - r[k]), 1.0), axis=1) for k in (0, 1)]
    return float((counts * np.log(prior * part[0] + (1 - prior) * part[1])).sum())


def table():
    """Counts of all vote patterns of three labellers under known rates, 70 % good texts."""
    good, bad = (0.995, 0.999, 0.995), (0.3, 0.2, 0.4)
    patterns = ["".join(p) for p in itertools.product("01", repeat=3)]
    share = lambda p, r: np.prod([x if c == "1" else 1 - x for c, x in zip(p, r)])
    counts = np.array([100_000 * (0.7 * share(p, good) + 0.3 * share(p, bad)) for p in patterns])
    truth = np.array([0.7 * share(p, good) / (0.7 * share(p, good) + 0.3 * share(p, bad)) for p in patterns])
    return patterns, counts, truth, bad


def test_em_recovers_known_rates():
    patterns, counts, truth, bad = table()
    post, rates, prior = quality.em(patterns, counts)
    assert abs(prior - 0.7) < 0.01
    assert np.abs(rates[1] - bad).max() < 0.02 and np.abs(rates[0] - (0.995, 0.999, 0.995)).max() < 0.005
    assert np.abs(post - truth).max() < 0.05


def test_em_raises_the_likelihood():
    patterns, counts, *_ = table()
    v = np.array([[float(c) for c in p] for p in patterns])
    has = np.ones_like(v, bool)
    seen = [log_likelihood(v, has, counts, *quality.em(patterns, counts, rounds=k)[1:]) for k in (1, 2, 3, 5, 10, 50, 200)]
    # the prior counts of three votes are not part of this likelihood: allow their trace
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def test_em_leaves_out_silent_labellers():
    patterns, counts = ["1-", "0-", "11", "00", "10"], np.array([50.0, 10.0, 60.0, 40.0, 3.0])
    post, rates, prior = quality.em(patterns, counts, rounds=2000)
    good, bad = rates
    # a silent labeller gives no factor, so "1-" and "0-" hang on the first one alone
    for i, (g, b) in ((0, (good[0], bad[0])), (1, (1 - good[0], 1 - bad[0]))):
        g, b = max(g, 1e-3), max(b, 1e-3)
        assert abs(post[i] - prior * g / (prior * g + (1 - prior) * b)) < 1e-3
    assert post[2] > 0.9 > 0.1 > post[3] and post[0] > 0.5 > post[1] and np.isfinite(rates).all()


def test_linear_fit_against_plain_gradient():
    rng = np.random.default_rng(1)
    w_true = rng.standard_normal(6) * 2
    rows = []
    for _ in range(400):
        at = sorted(rng.choice(6, 3, False).tolist())
        x = rng.random(3)
        rows.append((at, x.tolist(), float(1 / (1 + np.exp(-(w_true[at] @ x))))))
    w = quality.fit_linear(rows, steps=4000)

    def loss(w):
        z = np.array([w[a] @ np.array(x) for a, x, _ in rows]) + w[-1]
        y = np.array([p for *_, p in rows])
        return float(np.mean(np.log1p(np.exp(z)) - y * z) + 0.5e-4 * (w[:-1] ** 2).sum())

    plain = np.zeros(quality.DIMS + 1)
    for _ in range(6000):
        g = np.zeros_like(plain)
        for a, x, p in rows:
            gap = 1 / (1 + np.exp(-(plain[a] @ np.array(x) + plain[-1]))) - p
            g[a] += gap * np.array(x) / len(rows)
            g[-1] += gap / len(rows)
        g[:-1] += 1e-4 * plain[:-1]
        plain -= 4.0 * g
        if np.abs(g).max() < 1e-4:
            break
    assert loss(w) < loss(plain) + 1e-3


def test_smallest_hashes_are_those_of_all_rows(spark):
    from pyspark.sql import functions as F

    from cadence.llm import quality

    for df in (spark.range(5000).select(F.col("id").alias("doc_id")), spark.range(5000).select((F.col("id") % 3).alias("doc_id")), spark.range(7).select(F.col("id").alias("doc_id"))):
        want = [r[0] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()]
        assert [r[0] for r in quality.smallest_hashes(df, 100, df.count()).collect()] == want
