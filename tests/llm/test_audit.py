"""Source divergence audit: SQL is in test_llm; here the cases SQL on the given tables does not reach."""

import collections
import re

import numpy as np
import pandas as pd
import pytest

from cadence.llm import divergence
from cadence.llm.divergence import Audit, audit_sources

SCHEMA = "doc_id long, text string, lang string, source string, TEXT string"


def brute(docs, top=10, min_docs=10):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in docs]
    out = []
    for lang in {t[0] for t in terms}:
        seen = collections.Counter(w for la, _, ws in terms if la == lang for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= min_docs)
        v = len(kept)
        counts = {s: collections.Counter() for la, s, _ in terms if la == lang}
        for la, s, ws in terms:
            if la == lang:
                counts[s].update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), collections.Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, w), p(d, w)) for w in kept)) for o, d in counts.items() if o != s]
            own = [(w, f(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, x, k + 1) for k, (i, x) in enumerate(order[:most])]
    return sorted(out)


def made(n=400):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gämma", "日本", "\U0001f600x", "d", "E", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu"]
    rows = []
    for i in range(n):
        text = " 1-_".join(rng.choice(words, int(rng.integers(0, 12))))
        rows.append((i, text, ["en", "de", None][i % 3], [None, "a", "b", "é", "\U0001f600"][int(rng.integers(0, 5))], "x"))
    return rows + [(1, "alpha alpha", "en", "a", "x")] * 3 + [(None, None, "xx", "only", None), (5, "", "yy", "one", "x"), (6, "rare words", "yy", "two", "x")]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(audit_sources(docs)) == brute(rows)
    assert got(audit_sources(docs, top=3, min_docs=60)) == brute(rows, 3, 60)


def test_ties_are_expanded_in_utf8_order(spark):
    words = ["b", "a", "é", "z", "￮", "\U0001f600", "c", "d", "e", "f", "g", "h", "i"]
    rows = [(i, " ".join(words), "en", "s", "x") for i in range(10)] + [(99 + i, "other", "en", "t", "x") for i in range(10)]
    assert got(audit_sources(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    chosen = [r.item for r in Audit(spark.createDataFrame(rows, SCHEMA)).terms(10).orderBy("rank").collect() if r.source == "s"]
    assert chosen == sorted(words, key=str.encode)[:10]


def test_many_blocks_and_flushes_give_the_same(spark, monkeypatch):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(divergence, "PLACES", 6)
    monkeypatch.setattr(divergence, "OVER_PAIRS", 0)
    monkeypatch.setattr(divergence, "small_side", lambda t: t)
    assert got(audit_sources(docs)) == brute(rows)


def test_flush(monkeypatch):
    import pyarrow as pa

    texts = ["a b c a", "a d", "", None, "e A f", "x" * 100 + " " + "x" * 100, "é É \U0001f600É"]
    want = collections.Counter({"a": 4, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "x" * 100: 2, "é": 1, "É": 1, "\U0001f600É": 1})
    for chunk, held in ((1, 1), (5, 3), (8 << 20, 10), (8 << 20, 10**6)):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "HELD", held)
        batches = [pa.RecordBatch.from_pydict({"lang": ["x"] * 7, "source": ["s"] * 7, "text": texts})] * 3
        total, docs = collections.Counter(), collections.Counter()
        for b in divergence.count_terms(batches):
            for r in b.to_pylist():
                total[r["term"]] += r["c"]
                docs[r["term"]] += r["docs"]
        assert total == {k: 3 * n for k, n in want.items()}
        assert docs["a"] == 9 and docs["x" * 100] == 3


def test_equal_keys_are_told_apart():
    key, check = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 3], np.uint64)
    rep, (c, docs) = divergence.summed(key, check, None, np.array([0, 0, 1, 1]))
    assert rep.tolist() == [0, 1, 3] and c.tolist() == [2, 1, 1] and docs.tolist() == [2, 1, 1]


def test_empty(spark):
    assert audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_longs():
    big = np.array([10**13, 5], np.int64)
    assert divergence.shares(big, np.array([10**14, 10**14], np.int64), 7).tolist() == [1 + (c + 2) * 10**9 // (10**14 + 14) for c in (10**13, 5)]
    g = pd.DataFrame({"lang": "x", "source": ["a", "b"], "sources": [None, None], "counts": [None, None], "n": [0, 0], "v": [0, 0]})
    assert divergence.pair_sums(None, g)["part_value"].tolist() == [0, 0]


@pytest.mark.parametrize("c, n, v", [(0, 0, 1), (7, 9, 4), (10**17, 10**18, 10**6)])
def test_share_is_exact_in_spark(spark, c, n, v):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (c + 2) // (n + 2 * v)
