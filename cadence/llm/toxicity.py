"""Toxicity by nearest labelled examples under exact TF-IDF cosine over all terms.

1. *Sample*: ids and labels are joined first, as longs. At most ``MAX_LABELLED``
   training rows per class, those of the smallest id hashes, are learnt from; their
   ids are broadcast to the documents, so no text is shuffled.
2. *Lexicon*: over the distinct texts of the sample, terms whose document
   frequency among toxic texts is ``LIFT`` times that among clean ones, with a
   chi-square of ``CHI2`` at least. The lexicon cuts nothing away: its terms weigh
   ``BOOST`` times their TF-IDF.
3. *Examples*: the first ``MAX_EXAMPLES`` sampled texts per class of one fold, each
   with all its terms; these and the lexicon are the vocabulary. Every document is
   split into terms once and kept as its vocabulary terms with their counts;
   document frequencies are taken over all documents. A document's norm is over
   all its terms. Terms outside the vocabulary meet no example; in the norm they
   count as terms of a single document.
4. The index keeps the examples in blocks with the largest weight of each term
   per block. A query visits blocks by falling upper bound until none can reach
   the ``k``-th best cosine: the exact neighbours, ties by example id.
5. Votes are weighted by closeness and by the sampling rate of the class; a
   second fold of the training rows turns votes into calibrated probabilities
   by isotonic regression over at most ``LEVELS`` + 1 vote levels.

Neighbours are returned as evidence. Defined cases: null and empty texts and
texts that share no term with an example have no neighbours and get the
calibrated base rate; without usable labels all scores are the base rate; a null
id is never a training row; repeated rows score alike; the last of repeated
labels is the largest; of several texts under one id the one with the smallest
hash is the example.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import hold, pick, ship

LIFT, CHI2, LEAST, BOOST = 4.0, 20.0, 3, 6.0
#: Bounds per class of what is learnt from: labelled rows for the lexicon, examples in the index.
MAX_LABELLED, MAX_EXAMPLES = 20_000, 2_000
NEIGHBOURS, BLOCK, DENSE, LEVELS = 15, 64, 512, 1_000
TERM = re.compile(r"[^\W\d_]{2,}")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of every span, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class BlockMaxIndex:
    """Unit TF-IDF vectors in blocks, with the largest weight per term and block.

    Postings lie by term and place; the postings of a term in a block are one
    entry ``(block, largest weight, first posting, postings)``. The commonest terms
    have full rows, zeros included, which many queries multiply at once.
    """

    def __init__(self, ids: list[int], vectors: list[dict[int, float]], block: int = BLOCK):
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=vectors[i].get), ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.n_blocks = -(-len(order) // block)
        sizes = np.array([len(vectors[i]) for i in order], np.int64)
        term = np.array([t for i in order for t in vectors[i]], np.int64)
        weight = np.array([w for i in order for w in vectors[i].values()], np.float64)
        place = np.repeat(np.arange(len(order)), sizes)
        by = np.lexsort((place, term))
        term, self.place, self.weight = term[by], place[by].astype(np.int32), weight[by]
        at = self.place // block
        self.start = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(at) != 0)][: len(term)])
        self.size = np.diff(np.r_[self.start, len(term)])
        self.block = at[self.start]
        self.best = np.maximum.reduceat(self.weight, self.start) if len(term) else self.weight
        # entries of term t: first[t] .. first[t + 1] - 1
        self.first = np.searchsorted(term[self.start], np.arange((int(term[-1]) if len(term) else -1) + 2))
        held = np.bincount(term)
        common = np.argsort(-held, kind="stable")[:DENSE]
        common = common[held[common] * 16 >= len(order)]
        self.row = np.full(len(held), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n_blocks * block))
        full = self.row[term] >= 0
        self.rows[self.row[term[full]], self.place[full]] = self.weight[full]

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """``(cosine, place)`` of the ``k`` nearest with a positive cosine, ties by id."""
        return self.nearest_many([query], k)[0]

    def nearest_many(self, queries: list[dict[int, float]], k: int) -> list[list[tuple[float, int]]]:
        if not self.n_blocks:
            return [[] for _ in queries]
        q_rows, sparse = np.zeros((len(queries), len(self.rows))), []
        for a, query in enumerate(queries):
            t = np.fromiter(query.keys(), np.int64, len(query))
            q = np.fromiter(query.values(), np.float64, len(query))
            by = np.argsort(t)
            by = by[t[by] < len(self.row)]
            t, q = t[by], q[by]
            row = self.row[t]
            q_rows[a, row[row >= 0]] = q[row >= 0]
            sparse.append((t[row < 0], q[row < 0]))
        return [self._top(score, t, q, k) for score, (t, q) in zip(q_rows @ self.rows, sparse)]

    def _top(self, score: np.ndarray, t: np.ndarray, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Completes the cosines over the common terms by the terms ``t``, in the
        blocks that can still hold one of the ``k`` best."""
        n = self.first[t + 1] - self.first[t]
        entry, q = spans(self.first[t], n), np.repeat(q, n)
        block = self.block[entry]
        bound = score.reshape(self.n_blocks, -1).max(axis=1) + np.bincount(block, q * self.best[entry], self.n_blocks)
        # no cosine falls by further terms; a bound is a sum in another order: leave it some slack
        least = np.partition(score, -k)[-k] - 1e-9 if len(score) > k else 0.0
        open_ = bound >= least
        mine = open_[block]
        size = self.size[entry[mine]]
        post = spans(self.start[entry[mine]], size)
        score = score + np.bincount(self.place[post], np.repeat(q[mine], size) * self.weight[post], len(score))
        found = np.flatnonzero((score > 0) & np.repeat(open_, len(score) // self.n_blocks))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k] - 1e-11]
        return sorted(zip(score[found].tolist(), found.tolist()), key=lambda e: (-round(e[0], 12), self.ids[e[1]]))[:k]


def damped(counts: Iterable[int]) -> np.ndarray:
    return 1 + np.log(np.fromiter(counts, np.float64))


def unit(tf: dict[int, int], weight: np.ndarray, others: float = 0.0) -> dict[int, float]:
    """Unit vector of the vocabulary terms; ``others`` is what the squares of all
    further terms' weights add to the norm."""
    if not tf:
        return {}
    w = damped(tf.values()) * weight[np.fromiter(tf.keys(), np.int64, len(tf))]
    return dict(zip(tf.keys(), (w / np.sqrt((w * w).sum() + others)).tolist()))


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators on ascending ``x``: levels and rising rates."""
    pools: list[list[float]] = []
    for g, m in zip(good.tolist(), n.tolist()):
        pools.append([g, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, m2, c2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + m2, pools[-1][2] + c2]
    return x, np.concatenate([np.full(int(c), g / m) for g, m, c in pools])


def in_terms(words):
    """Documents as vocabulary terms (numbers, then counts) and the squares of the damped counts of all others."""

    def run(batches):
        lex = words.value
        for b in batches:
            known, rest = [], []
            for x in b.column("text"):
                tf = Counter(terms(x.as_py()))
                mine = {lex[t]: c for t, c in tf.items() if t in lex}
                known.append(np.array([*mine.keys(), *mine.values()], np.int32).tobytes())
                o = damped(c for t, c in tf.items() if t not in lex)
                rest.append(float((o * o).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(known, pa.binary()), pa.array(rest, pa.float64())], ["doc_id", "known", "rest"])

    return run


def counted_terms(raw: bytes) -> dict[int, int]:
    v = np.frombuffer(raw, np.int32).reshape(2, -1)
    return dict(zip(v[0].tolist(), v[1].tolist()))


def frequencies(size: int):
    """Documents per vocabulary term; behind the last term, all documents."""

    def run(batches):
        df = np.zeros(size + 1, np.int64)
        for b in batches:
            for x in b.column("known"):
                v = np.frombuffer(x.as_py(), np.int32)
                df[v[: len(v) // 2]] += 1
            df[-1] += b.num_rows
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(df[t], pa.int64())], ["t", "n"])

    return run


def vote(top: list[tuple[float, int]], share: dict[int, float], prior: float) -> float:
    """Weight of the toxic among the neighbours ``(cosine, label)``; the base rate votes weakly."""
    up, every = 0.2 * prior, 0.2
    for s, y in top:
        v = share[y] * s / (1.05 - min(s, 1.0))
        up, every = up + v * y, every + v
    return up / every


def votes(model):
    def run(batches):
        idx, y_of, share, prior, weight, rare = model.value
        seen: dict[tuple, tuple[float, list[int]]] = {}
        for b in batches:
            if len(seen) > 100_000:
                seen.clear()
            keys = list(zip(b.column("known").to_pylist(), b.column("rest").to_pylist()))
            todo = [k for k in dict.fromkeys(keys) if k not in seen]
            for at in range(0, len(todo), 128):
                part = todo[at : at + 128]
                asked = [unit(counted_terms(raw), weight, rest * rare * rare) for raw, rest in part]
                for key, top in zip(part, idx.nearest_many(asked, NEIGHBOURS)):
                    ids = [int(idx.ids[i]) for _, i in top]
                    # the last digits of a product of matrices depend on its neighbours in the batch
                    seen[key] = round(vote([(s, y_of[i]) for (s, _), i in zip(top, ids)], share, prior), 9), ids[:3]
            raws, near = [seen[k][0] for k in keys], [seen[k][1] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(raws, pa.float64()), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "raw", "neighbours"]
            )

    return run


def calibration(levels: list[int], toxic: list[float], every: list[float]) -> list[float]:
    """Calibrated rate of each vote level ``0 .. LEVELS``, rising. The base rate as a
    weak witness at both ends keeps the rates off 0 and 1 where rows are few."""
    x, p = isotonic(np.array([0, *levels, LEVELS]), np.array([0.0, *toxic, 1.0]), np.array([1.0, *every, 1.0]))
    return p[np.searchsorted(x, np.arange(LEVELS + 1), "right") - 1].tolist()


def score_documents(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, held_out_fold: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, raw, score, neighbours)`` per row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    fold = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % folds).cast("int")
    index_fold = next(f for f in range(folds) if f != held_out_fold)
    lab = pick(labels, id_col, label_col).toDF("lid", "y").filter("lid is not null and y is not null").groupBy("lid").agg(F.max("y").cast("int").alias("y"))
    lab = lab.filter(fold("lid") != held_out_fold).select(F.col("lid").cast("long").alias("lid"), F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))

    # training rows: labelled ids outside the held-out fold that have a document
    train = hold(lab.join(d.select("doc_id").distinct(), F.col("lid") == F.col("doc_id")).select("doc_id", "y"), "toxic-train")
    order = F.xxhash64("doc_id")
    sizes, shown = {}, {}
    for r in train.groupBy("y", (fold("doc_id") == index_fold).alias("index")).agg(F.count("*").alias("n")).collect():
        sizes[r["y"]] = sizes.get(r["y"], 0) + r["n"]
        shown[r["y"]] = shown.get(r["y"], 0) + r["n"] * r["index"]
    chosen = None
    for y, n in sorted(sizes.items()):
        # a cut of the hash range first, so that the exact smallest hashes are sought among few
        near = train.filter((F.col("y") == y) & (F.pmod(order, F.lit(1 << 32)) <= int(min(1.0, 1.5 * MAX_LABELLED / n) * (1 << 32))))
        some = near.orderBy(F.pmod(order, F.lit(1 << 32)), "doc_id").limit(MAX_LABELLED)
        chosen = some if chosen is None else chosen.union(some)
    chosen = hold(train.limit(0) if chosen is None else chosen, "toxic-chosen")

    def with_terms(batches):
        for b in batches:
            some = [TERM.search(t.lower()) is not None for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "y", "h")), pa.array(some)], ["doc_id", "y", "h", "some"])

    texts = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), "text")
    known = hold(texts.mapInArrow(with_terms, "doc_id long, y int, h long, some boolean").groupBy("doc_id", "y", "h", "some").agg(F.count("*").alias("rows")), "toxic-known")

    def count(batches):
        seen, n = (Counter(), Counter()), [0.0, 0.0]
        for b in batches:
            for text, y, rows in zip(*(b.column(c).to_pylist() for c in ("text", "y", "rows"))):
                for t in set(terms(text)):
                    seen[y][t] += 1 / rows
                n[y] += 1 / rows
        seen[0][""], seen[1][""] = n
        names = list(seen[0].keys() | seen[1].keys())
        clean, toxic = (pa.array([float(s[t]) for t in names], pa.float64()) for s in seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), toxic, clean], ["term", "tox", "clean"])

    # a text that many ids repeat counts once, and its repeated rows count as one
    hashed = d.withColumn("h", F.xxhash64("text"))
    once = known.groupBy("h", "y").agg(F.min_by(F.struct("doc_id", "rows"), "doc_id").alias("k")).select("h", "y", "k.doc_id", "k.rows")
    total = lambda c: F.round(F.sum(c)).cast("long").alias(c)
    df = hold(
        hashed.join(F.broadcast(hold(once, "toxic-once")), ["doc_id", "h"]).select("text", "y", "rows")
        .mapInArrow(count, "term string, tox double, clean double").groupBy("term").agg(total("tox"), total("clean"))
        .filter((F.col("tox") >= LEAST) | (F.col("term") == "")),
        "toxic-terms",
    )
    whole = df.filter("term = ''").first()
    nt, nc = (whole["tox"], max(whole["clean"], 1)) if whole else (0, 1)
    a, b = F.col("tox").cast("double"), F.col("clean").cast("double")
    c, e = F.lit(float(nt)) - a, F.lit(float(nc)) - b
    chi2 = F.lit(float(nt + nc)) * F.pow(a * e - b * c, 2) / ((a + b) * (c + e) * F.lit(float(max(nt, 1))) * F.lit(float(nc)) + F.lit(1e-9))
    strong = df.filter("term <> ''").filter((a / max(nt, 1) >= LIFT * (b + 0.5) / nc) & (chi2 >= CHI2))
    lexicon = {r["term"] for r in strong.select("term").collect()}

    def as_counts(batches):
        for b in batches:
            tfs = [Counter(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([[*tf] for tf in tfs], pa.list_(pa.string())), pa.array([[*tf.values()] for tf in tfs], pa.list_(pa.int32()))],
                ["doc_id", "y", "terms", "counts"],
            )

    candidates = known.filter((fold("doc_id") == index_fold) & F.col("some")).groupBy("doc_id", "y").agg(F.min("h").alias("h"))
    examples: dict[int, tuple[int, Counter]] = {}
    for y in sorted(sizes):
        ids = candidates.filter(F.col("y") == y).orderBy(order, "doc_id").limit(MAX_EXAMPLES)
        rows = hashed.join(F.broadcast(hold(ids, "toxic-examples")), ["doc_id", "h"]).select("doc_id", "y", "text")
        for r in rows.mapInArrow(as_counts, "doc_id long, y int, terms array<string>, counts array<int>").toLocalIterator():
            examples[r["doc_id"]] = (y, Counter(dict(zip(r["terms"], r["counts"]))))
    at = {t: i for i, t in enumerate(sorted(lexicon | {t for _, tf in examples.values() for t in tf}))}
    words = spark.sparkContext.broadcast(at)
    split = hold(d.mapInArrow(in_terms(words), "doc_id long, known binary, rest double"), "toxic-split")

    df_all = np.zeros(len(at) + 1, np.int64)
    for b in split.select("known").mapInArrow(frequencies(len(at)), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow().to_batches():
        df_all[b.column("t").to_numpy()] = b.column("n").to_numpy()
    idf = np.log((df_all[-1] + 1) / (df_all[:-1] + 1)) + 1
    idf[[at[t] for t in lexicon]] *= BOOST
    rare = float(np.log((df_all[-1] + 1) / 2) + 1)
    ids = sorted(examples)
    index = BlockMaxIndex(ids, [unit({at[t]: c for t, c in examples[i][1].items()}, idf) for i in ids])
    taken = Counter(y for y, _ in examples.values())
    rate = {y: shown[y] / taken[y] for y in taken}
    base = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    model = spark.sparkContext.broadcast((index, {i: examples[i][0] for i in ids}, rate, base, idf, rare))

    voted = hold(split.mapInArrow(votes(model), "doc_id long, raw double, neighbours array<long>"), "toxic-votes")
    level = F.round(F.col("raw") * LEVELS).cast("int")
    check = voted.select("doc_id", level.alias("x")).join(train.filter(fold("doc_id") != index_fold), "doc_id")
    hist = check.groupBy("x").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).orderBy("x").collect()
    p = calibration([r["x"] for r in hist], [float(r["toxic"]) for r in hist], [float(r["n"]) for r in hist])
    return voted.select(
        "doc_id",
        F.coalesce(fold("doc_id") == held_out_fold, F.lit(False)).alias("held_out"),
        "raw",
        # equal calibrated levels keep the order of the votes
        F.least(F.greatest(F.get(F.lit(p), level) * 0.999 + F.col("raw") * 0.001, F.lit(0.0)), F.lit(1.0)).alias("score"),
        "neighbours",
    )
