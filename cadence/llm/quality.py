"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text.
Expectation-maximisation over the counts of vote patterns (at most ``3**L``
rows, whatever the corpus) estimates each labeller's accuracy on good and on bad
texts and the share of good texts; the posterior of a pattern is the weak label
of its documents. A linear scorer over hashed features is then trained on the
weak labels of at most ``SAMPLE`` documents, chosen by the hash of their id, and
scores every whole text. No given label is read.

Defined cases: a null or empty text is scored as a text without features and
votes bad on length; ties of the sample's hash go by id; repeated rows score
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import hold, pick, ship

SAMPLE, DIMS, KEEP = 6_000, 1 << 12, 0.5
#: Byte classes of word shapes: A, a (with all of UTF-8's other bytes), 0, the rest as they are.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
SQUEEZE = [(re.compile(rb"aa+"), b"a"), (re.compile(rb"AA+"), b"A"), (re.compile(rb"00+"), b"0")]
MARKS = b"#*$%&|<>!"


def vote(bad: bool, good: bool) -> str:
    return "0" if bad else "1" if good else "-"


def look(text: bytes) -> tuple[str, dict[int, float]]:
    """Votes of the labellers and hashed features of one text."""
    w = text.split()
    n = len(w)
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    shape = text.translate(SHAPE)
    upper, letters = shape.count(b"A"), shape.count(b"A") + shape.count(b"a")
    marks = sum(text.count(bytes([m])) for m in MARKS)
    distinct = len(set(w)) / max(n, 1)
    echo = sum(a == b for a, b in zip(w, w[1:])) / max(n, 1)
    repeats = 1 - len(set(lines)) / max(len(lines), 1)
    ended = sum(x[-1:] in b".!?\"'" for x in lines) / max(len(lines), 1)
    length = (len(text) - text.count(b" ")) / max(n, 1)
    for pattern, one in SQUEEZE:
        shape = pattern.sub(one, shape)
    words = Counter(shape.split())
    marked = sum(c for s, c in words.items() if not set(MARKS).isdisjoint(s)) / max(n, 1)
    votes = "".join(
        [
            vote(n < 3, n >= 20),
            vote(upper * 2 > letters, upper * 5 < letters),
            vote(marks * 5 > n, marks * 50 < n),
            vote(repeats > 0.3, len(lines) > 3 and repeats < 0.1),
            vote(echo > 0.25, n >= 20 and echo < 0.05),
            vote(n >= 30 and distinct < 0.35, n >= 30 and distinct > 0.5),
            vote(bool(lines) and ended < 0.05 and n > 60, ended > 0.3),
            vote(length > 15 or length < 2, 3 <= length <= 12),
            vote(marked > 0.25, marked < 0.05),
        ]
    )
    feats: Counter = Counter()
    for s, c in words.items():
        feats[zlib.crc32(s) % DIMS] += c
    out = {k: 1.0 + float(np.log(v)) for k, v in feats.items()}
    norm = np.sqrt(sum(x * x for x in out.values())) or 1.0
    out = {k: x / norm for k, x in out.items()}
    for name, value in (("d", distinct), ("e", echo), ("r", repeats), ("p", ended), ("u", upper / max(letters, 1)), ("m", min(1.0, marks / max(n, 1)))):
        out[zlib.crc32(f"{name}{int(value * 10)}".encode()) % DIMS] = 1.0
    out[zlib.crc32(f"n{min(n, 4095).bit_length()}".encode()) % DIMS] = 1.0
    return votes, out


def em(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" per pattern, each labeller's rate of voting good on
    good and on bad texts (2 x L), and the share of good texts."""
    v = np.array([[{"1": 1.0, "0": 0.0}.get(c, np.nan) for c in p] for p in patterns])
    has, v = ~np.isnan(v), np.nan_to_num(v)
    # labellers rarely fire "bad" without cause: start from texts that none objects to
    post = np.where(((1 - v) * has).any(axis=1), 0.05, 0.95)
    rates, prior = np.zeros((2, v.shape[1])), 0.5
    for _ in range(rounds):
        was = post
        for k, p in enumerate((post, 1 - post)):
            weight = (counts * p)[:, None] * has
            rates[k] = ((weight * v).sum(axis=0) + (2.0, 1.0)[k]) / (weight.sum(axis=0) + 3.0)
        prior = float(np.clip((counts * post).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        r = np.clip(rates, 1e-3, 1 - 1e-3)
        ll = [(has * (v * np.log(r[k]) + (1 - v) * np.log(1 - r[k]))).sum(axis=1) for k in (0, 1)]
        z = np.clip(np.log(prior) + ll[0] - np.log(1 - prior) - ll[1], -50, 50)
        post = 1 / (1 + np.exp(-z))
        if np.abs(post - was).max() < 1e-9:
            break
    return post, rates, prior


def fit_linear(rows: list[tuple[list[int], list[float], float]], steps: int = 300, rate: float = 2.0, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the constant."""
    at = np.concatenate([np.full(len(i), k) for k, (i, _, _) in enumerate(rows)]).astype(np.int64)
    col = np.concatenate([np.array(i, np.int64) for i, _, _ in rows])
    val = np.concatenate([np.array(x, float) for _, x, _ in rows])
    y = np.array([p for _, _, p in rows])
    w, m = np.zeros(DIMS + 1), len(rows)
    speed = np.full(DIMS + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(at, w[col] * val, m) + w[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(col, gap[at] * val, DIMS) / m, gap.mean()) + l2 * np.append(w[:-1], 0)
        speed += g * g
        w -= rate * 0.1 * g / np.sqrt(speed)
    return w


def smallest_hashes(table: DataFrame, most: int, rows: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of their ids. Rows with large hashes are
    left out first, for every task sends as many rows as are asked for."""
    h, share = F.xxhash64("doc_id"), 2 * most / max(rows, 1)
    near = table
    while share < 1:
        near = table.filter(h < F.lit(int(share * (1 << 64)) - (1 << 63)))
        if near.count() >= most:
            break
        near, share = table, 4 * share  # many rows with one id
    return near.orderBy(h, "doc_id").limit(most)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, votes, weak_label, score, kept)`` per row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def scan(batches):
        for b in batches:
            seen = [look(t.as_py().encode()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([v for v, _ in seen], pa.string()),
                    pa.array([list(f) for _, f in seen], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for _, f in seen], pa.list_(pa.float32())),
                ],
                ["doc_id", "votes", "at", "value"],
            )

    table = hold(d.mapInArrow(scan, "doc_id long, votes string, at array<int>, value array<float>"), "quality-features")
    found = table.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not found:
        return table.select("doc_id", "votes", F.lit(0.5).alias("weak_label"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    names = [r["votes"] for r in found]
    post, _, _ = em(names, np.array([float(r["n"]) for r in found]))
    soft = dict(zip(names, post.tolist()))
    sample = smallest_hashes(table, SAMPLE, sum(r["n"] for r in found)).collect()
    w = fit_linear([(r["at"], r["value"], soft[r["votes"]]) for r in sample])
    model = spark.sparkContext.broadcast((w, soft))

    def score(frames):
        weights, label = model.value
        for g in frames:
            z = np.array([float(weights[np.asarray(a, np.int64)] @ np.asarray(v, float)) if len(a) else 0.0 for a, v in zip(g["at"], g["value"])]) + weights[-1]
            yield pd.DataFrame(
                {"doc_id": g["doc_id"].astype("Int64"), "votes": g["votes"], "weak_label": g["votes"].map(label), "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))}
            )

    out = table.mapInPandas(score, "doc_id long, votes string, weak_label double, score double")
    return out.withColumn("kept", F.col("score") >= KEEP)
