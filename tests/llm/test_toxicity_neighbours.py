"""Toxicity neighbours against a brute-force TF-IDF cosine over all terms."""

import collections
import math
import zlib

import numpy as np
import pytest

from cadence.llm import toxicity


def word(n):
    return "".join(chr(97 + n // 26**k % 26) for k in (3, 2, 1, 0))


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


@pytest.fixture(scope="module")
def corpus():
    """Texts and labels; examples come from fold 0, fold 1 is held out."""
    rng = np.random.default_rng(6)
    some = lambda n: [word(int(x)) for x in rng.integers(0, 3000, n)]
    ids = {f: iter([i for i in range(1, 2000) if fold(i) == f]) for f in range(3)}
    texts, labels = {}, {}
    for k in range(60):
        i = next(ids[(0, 2)[k % 2]])
        texts[i], labels[i] = " ".join(some(40)), 0
    for k in range(30):
        i = next(ids[(0, 2)[k % 2]])
        texts[i], labels[i] = "idiot " + " ".join(some(3)), 1
    # a toxic text without any term of the lexicon, and a near copy of it
    odd, copy = next(ids[0]), next(ids[1])
    own = [word(9000 + x) for x in range(30)]
    texts[odd], labels[odd], texts[copy] = " ".join(own), 1, " ".join(own[1:])
    # a long clean text with one term of the lexicon that copies a labelled clean text
    clean, long = next(ids[0]), next(ids[1])
    body = [word(20000 + x) for x in range(500)]
    texts[clean], labels[clean], texts[long] = " ".join(body), 0, " ".join(["idiot", *body])
    return texts, labels, odd, copy, clean, long


def brute(texts, labels, lexicon):
    tf = {i: collections.Counter(toxicity.terms(t)) for i, t in texts.items()}
    df = collections.Counter(t for c in tf.values() for t in c)
    shown = sorted(i for i in labels if fold(i) == 0)
    known = lexicon | {t for i in shown for t in tf[i]}
    idf = {t: math.log((len(texts) + 1) / ((n if t in known else 1) + 1)) + 1 for t, n in df.items()}
    vec = {i: {t: (1 + math.log(c)) * idf[t] * (toxicity.BOOST if t in lexicon else 1) for t, c in v.items()} for i, v in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    out = {}
    for i, v in vec.items():
        cos = [(round(sum(x * vec[e].get(t, 0) for t, x in v.items()) / norm[i] / norm[e], 9), e) for e in shown]
        out[i] = [e for s, e in sorted(cos, key=lambda x: (-x[0], x[1])) if s > 0][:3]
    return out


def test_neighbours_are_nearest_over_all_terms(spark, corpus):
    texts, labels, odd, copy, clean, long = corpus
    got = toxicity.score_documents(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
        spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"),
    )
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[copy]["neighbours"][0] == odd and by[copy]["raw"] > 0.7
    assert by[long]["neighbours"][0] == clean and by[long]["raw"] < 0.7
    want = brute(texts, labels, {"idiot"})
    assert {i: r["neighbours"] for i, r in by.items()} == want


def test_norm_is_over_all_terms():
    w = np.array([2.0, 3.0])
    v = toxicity.unit({0: 1}, w, 2 * 4.0**2)
    assert v[0] == pytest.approx(2 / 6)
    assert toxicity.unit({}, w, 16.0) == {}


def plain_isotonic(points):
    """Least-squares rising fit by the min-max formula: (toxic, all) per level."""
    n = len(points)
    rate = lambda a, b: sum(p[0] for p in points[a : b + 1]) / sum(p[1] for p in points[a : b + 1])
    return [max(min(rate(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_votes_calibration_and_predictions(spark, corpus):
    """Every score from its neighbours: plain votes over all examples, plain isotonic
    fit over the calibration fold, the threshold of the query."""
    texts, labels, *_ = corpus
    got = {
        r["doc_id"]: r
        for r in toxicity.score_documents(
            spark.createDataFrame([*texts.items(), (900_001, ""), (900_002, None)], "doc_id long, text string"),
            spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"),
        ).collect()
    }
    every = {**texts, 900_001: "", 900_002: ""}
    tf = {i: collections.Counter(toxicity.terms(t)) for i, t in every.items()}
    shown = sorted(i for i in labels if fold(i) == 0)
    known = {"idiot"} | {t for i in shown for t in tf[i]}
    df = collections.Counter(t for c in tf.values() for t in c if t in known)
    idf = collections.defaultdict(lambda: math.log((len(every) + 1) / 2) + 1, {t: math.log((len(every) + 1) / (n + 1)) + 1 for t, n in df.items()})
    idf["idiot"] *= toxicity.BOOST
    vec = {i: {t: (1 + math.log(c)) * idf[t] for t, c in v.items()} for i, v in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    # every training row is shown, so both classes weigh one a head; the labels outside the held-out fold give the base rate
    base = sum(labels.values()) / len(labels)
    raw = {}
    for i, v in vec.items():
        cos = sorted(((sum(x * vec[e].get(t, 0) for t, x in v.items()) / norm[i] / norm[e] if v else 0, e) for e in shown), key=lambda x: (-round(x[0], 12), x[1]))
        up, all_ = 0.2 * base, 0.2
        for s, e in [c for c in cos if c[0] > 0][: toxicity.NEIGHBOURS]:
            w = s / (1.05 - min(s, 1.0))
            up, all_ = up + w * labels[e], all_ + w
        raw[i] = up / all_
        assert got[i]["raw"] == pytest.approx(raw[i], abs=1e-9)
    assert got[900_001]["raw"] == got[900_002]["raw"] == pytest.approx(base)
    check = collections.defaultdict(lambda: [0.0, 0.0])
    for i, y in labels.items():
        if fold(i) == 2:
            p = check[math.floor(raw[i] * 1000 + 0.5)]
            p[0], p[1] = p[0] + y, p[1] + 1
    levels = [0, *sorted(check), 1000]
    fit = plain_isotonic([[0.0, 1.0], *[check[x] for x in sorted(check)], [1.0, 1.0]])
    for i in every:
        at = max(k for k, x in enumerate(levels) if x <= math.floor(raw[i] * 1000 + 0.5))
        score = min(1.0, max(0.0, fit[at] * 0.999 + raw[i] * 0.001))
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
        assert got[i]["held_out"] == (fold(i) == 1)


def test_learns_from_a_bounded_sample(spark, corpus, monkeypatch):
    texts, labels, *_ = corpus
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 12)
    monkeypatch.setattr(toxicity, "MAX_EXAMPLES", 5)
    d = toxicity.score_documents(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    ).collect()
    assert len(d) == len(texts) and len({n for r in d for n in r["neighbours"]}) <= 10
    assert all(0 <= r["score"] <= 1 for r in d)


def test_repeated_rows_and_copies_count_once(spark, corpus):
    texts, labels, *_ = corpus
    rows = [*texts.items(), *list(texts.items())[:40]]
    twice = toxicity.score_documents(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([*labels.items()] * 2, "doc_id long, toxic int")
    )
    assert twice.count() == len(rows)
    by = collections.defaultdict(set)
    for r in twice.collect():
        by[r["doc_id"]].add((r["raw"], r["score"]))
    assert all(len(v) == 1 for v in by.values())
