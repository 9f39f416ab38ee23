"""Source divergence audit: how far the sources of a language lie apart, and which
terms set a source off from its language.

Terms are runs of letters A-Z and of code points from U+0080, A-Z lower-cased.
A language keeps the terms that ``min_docs`` of its documents hold. A group (a
source of a language), and the language as a whole, gives every kept term the
share ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``; two shares differ by
``f = floor((p - q)^2 / (p + q))``. All arithmetic is exact.

Term ranking goes by count cells: all terms of a group with one (group count,
language count) have one ``f``, so ``f`` is evaluated once a cell, cells of equal
value are merged, values are ranked by the cumulated number of their terms, and
only the cells that reach the wanted ranks are expanded into terms, in UTF-8
order. The ranking never sorts the terms of a group.

Pair values are sums over all kept terms. Terms are dealt into blocks of a
bounded number of (term, source) places by the hash of the term; a block gives
one partial sum for each pair of sources, so no pairs are made per term.

Defined cases: null text, language and source count as ''; every row is a
document of its own, repeated rows included; a language without kept terms has
pair values 0 and no terms; a source alone in its language has no pairs; an
empty table gives an empty result; further columns do not matter. Memory of a
counting task is bounded by ``HELD`` terms besides one chunk of texts or one text.
Inside a task terms are equal by 128 hash bits, between tasks by their bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadence.llm.common import hold, pick, ship, small_side
from cadence.llm.textnp import BASES, U, mix, text_bytes, word_hashes, words

SCALE = 1_000_000_000
#: Bytes of text that a counting task looks at together, and terms it holds at most before it hands them on.
CHUNK, HELD = 8 << 20, 1_500_000
#: Places (terms x sources) of a block of the pair sums, at least so many times its pairs.
PLACES, OVER_PAIRS = 200_000, 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
INK = np.zeros(256, bool)
INK[ord("a") : ord("z") + 1] = INK[128:] = True
NAMES = ["lang", "source", "term", "c", "docs"]
COUNTED = "lang string, source string, term string, c long, docs long"


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and bytes of the given words, one after the other."""
    end = np.cumsum(size)
    return end, data[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


def summed(key, check, values, doc=None):
    """Order, heads and sums of entries of equal ``(key, check)``; with ``doc`` (ascending)
    the second sum counts documents."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    if (check[order] != check[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]).any():
        order = np.lexsort((np.arange(len(key)), check, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])]
    at = np.flatnonzero(new)
    if doc is not None:
        other = new.copy()
        other[1:] |= doc[order][1:] != doc[order][:-1]
        return order[at], [np.diff(at, append=len(new)), np.add.reduceat(other.astype(np.int64), at)]
    return order[at], [np.add.reduceat(v[order], at) for v in values]


class Held:
    """Terms of a task, by group and 128 hash bits, with their bytes."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.parts: list[tuple] = []

    def add(self, gid: np.ndarray, off: np.ndarray, data: np.ndarray) -> None:
        data = LOWER[data]
        s, e, first = words(off, data, INK[data])
        if not len(s):
            return
        doc = np.repeat(np.arange(len(gid)), np.diff(first))
        key = mix(word_hashes(data, s, e) + gid[doc].astype(U) * U(BASES[0]))
        rep, (c, docs) = summed(key, word_hashes(data, s, e, 1), None, doc)
        end, raw = gathered(data, s[rep], (e - s)[rep])
        self.parts.append((key[rep], word_hashes(data, s[rep], e[rep], 1), gid[doc[rep]], c, docs, end, raw))

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        key, check, gid, c, docs = (np.concatenate([p[i] for p in self.parts]) for i in range(5))
        size = np.concatenate([np.diff(p[5], prepend=0) for p in self.parts])
        start = np.cumsum(size) - size
        rep, (c, docs) = summed(key, check, (c, docs))
        end, raw = gathered(np.concatenate([p[6] for p in self.parts]), start[rep], size[rep])
        self.parts = [(key[rep], check[rep], gid[rep], c, docs, end, raw)]

    def hand_on(self):
        names = list(self.groups)
        lang, source = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
        for _, _, gid, c, docs, end, raw in self.parts:
            for a in range(0, len(gid), 100_000):
                z = min(a + 100_000, len(gid))
                base = int(end[a - 1]) if a else 0
                off = np.r_[0, end[a:z] - base].astype(np.int32)
                term = pa.StringArray.from_buffers(z - a, pa.py_buffer(off.tobytes()), pa.py_buffer(raw[base : end[z - 1]].tobytes()))
                g = pa.array(gid[a:z])
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), term, pa.array(c[a:z]), pa.array(docs[a:z])], NAMES)
        self.parts = []


def count_terms(batches):
    """Occurrences and documents of each (language, source, term) of a task."""
    held = Held()
    for b in batches:
        pairs = zip(b.column("lang").to_pylist(), b.column("source").to_pylist())
        gid = np.array([held.groups.setdefault(p, len(held.groups)) for p in pairs], np.int64)
        off, data = text_bytes(b.column("text"))
        i = 0
        while i < len(gid):
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1)
            held.add(gid[i:j], off[i : j + 1] - off[i], data[off[i] : off[min(j, len(gid))]])
            i = j
        if len(held) >= HELD:
            held.merge()
            if len(held) >= HELD // 2:
                yield from held.hand_on()
    held.merge()
    yield from held.hand_on()


def share(count: Column, n: Column, v: Column) -> Column:
    """The share of a term, exact at any count."""
    up = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    down = n.cast("decimal(20,0)") + 2 * v
    return F.call_function("div", up, down) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """``share`` for arrays of longs."""
    if count.max(initial=0) < 9_000_000_000:
        return 1 + (count + 2) * SCALE // (n + 2 * v)
    return np.array([1 + (int(c) + 2) * SCALE // (int(m) + 2 * v) for c, m in zip(*np.broadcast_arrays(count, n))], np.int64)


def pair_sums(_, g: pd.DataFrame) -> pd.DataFrame:
    """Partial pair values of the sources of a language over one block of its terms."""
    head = g[g["source"].notna()].sort_values("source")
    names, n, v = head["source"].to_numpy(), head["n"].to_numpy(np.int64), int(head["v"].iloc[0])
    rows = g[g["source"].isna()]
    total = np.zeros((len(names), len(names)), np.int64)
    if len(rows):
        at = pd.Index(names).get_indexer(np.concatenate(rows["sources"].to_list()))
        ti = np.repeat(np.arange(len(rows)), rows["sources"].map(len))
        p = np.repeat(shares(np.zeros(len(names), np.int64), n, v)[:, None], len(rows), axis=1)
        p[at, ti] = shares(np.concatenate(rows["counts"].to_list()).astype(np.int64), n[at], v)
        for i in range(len(names)):
            d = p[i + 1 :] - p[i]
            total[i, i + 1 :] = (d * d // (p[i + 1 :] + p[i])).sum(axis=1)
        total += total.T
    i, j = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": g["lang"].iloc[0], "source": names[i], "item": names[j], "part_value": total[i, j]})


class Audit:
    """Counts of one corpus, written once; ``pairs`` and ``terms`` read them.

    ``groups``  (lang, source, n, v): every group, its occurrences of kept terms,
    and the number of kept terms of its language;
    ``kept``  (lang, term, lc, sources, counts): a kept term, its occurrences in the
    language, and the sources that have it with their occurrences.
    """

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10):
        spark = docs.sparkSession
        ship(spark)
        d = pick(docs, lang_col, source_col, text_col).toDF("lang", "source", "text")
        d = d.select(*[F.coalesce(c, F.lit("")).alias(c) for c in d.columns])
        # tasks hand on sums already; one exchange by term serves the sums by group, then by language
        dealt = d.mapInArrow(count_terms, COUNTED).repartition("lang", "term")
        counted = dealt.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
        each = F.collect_list(F.struct("source", "c"))
        kept = counted.groupBy("lang", "term").agg(F.sum("c").alias("lc"), F.sum("docs").alias("docs"), each.alias("of")).filter(F.col("docs") >= min_docs)
        self.kept = hold(kept.select("lang", "term", "lc", F.col("of.source").alias("sources"), F.col("of.c").alias("counts")), "audit-kept")
        vocabulary = self.kept.groupBy("lang").agg(F.count("*").alias("v"))
        used = self.each().groupBy("lang", "source").agg(F.sum("c").alias("n"))
        every = d.select("lang", "source").distinct()
        zero = F.lit(0).cast("long")
        self.groups = hold(
            every.join(used, ["lang", "source"], "left").join(vocabulary, "lang", "left")
            .select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v")),
            "audit-groups",
        )

    def each(self, *cols: str) -> DataFrame:
        """``(lang, source, c, lc)``, with ``cols``: a row for each group and term it has."""
        return self.kept.select("lang", *cols, "lc", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select(
            "lang", *cols, F.col("e.sources").alias("source"), F.col("e.counts").alias("c"), "lc"
        )

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value, rank)``: every other source of the language."""
        n = F.count("*")
        places = F.ceil(n * F.max("v") / F.greatest(F.lit(float(PLACES)), n * n * F.lit(float(OVER_PAIRS)))).cast("int")
        blocks = small_side(hold(self.groups.groupBy("lang").agg(F.greatest(F.lit(1), places).alias("blocks")), "audit-blocks"))
        no_long = F.lit(0).cast("long")
        head = (
            self.groups.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("lang", "block", "source", "n", "v", F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("array<long>").alias("counts"))
        )
        body = self.kept.join(blocks, "lang").select(
            "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), F.lit(None).cast("string").alias("source"),
            no_long.alias("n"), no_long.alias("v"), "sources", "counts",
        )
        sums = head.union(body).groupBy("lang", "block").applyInPandas(pair_sums, "lang string, source string, item string, part_value long")
        value = sums.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return value.withColumn("rank", F.row_number().over(order))

    def terms(self, top: int = 10) -> DataFrame:
        """``(lang, source, item, value, rank)``: the ``top`` terms a group has more of than its language."""
        whole = self.groups.groupBy("lang").agg(F.sum("n").alias("ln"))
        cells = self.each().groupBy("lang", "source", "c", "lc").agg(F.count("*").alias("terms"))
        totals = hold(self.groups.join(whole, "lang"), "audit-totals")
        valued = (
            cells.join(small_side(totals), ["lang", "source"])
            .withColumn("p", share(F.col("c"), F.col("n"), F.col("v"))).withColumn("q", share(F.col("lc"), F.col("ln"), F.col("v")))
            .filter("p > q").select("lang", "source", "c", "lc", "terms", gap(F.col("p"), F.col("q")).alias("value"))
        )
        valued = hold(valued, "audit-cells")
        # every value stands for a term at least, so that more than ``top`` values are never needed
        falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        best = (
            valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
            .withColumn("at", F.row_number().over(falling)).filter(F.col("at") <= top)
            .withColumn("before", F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms"))
            .filter(F.col("before") < top).select("lang", "source", "value")
        )
        chosen = hold(valued.join(best, ["lang", "source", "value"]).select("lang", "source", "c", "lc", "value"), "audit-best")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return (
            self.each("term").join(small_side(chosen), ["lang", "source", "c", "lc"]).select("lang", "source", F.col("term").alias("item"), "value")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        )


def audit_sources(docs: DataFrame, top: int = 10, min_docs: int = 10) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part 'pair' and part 'term' of every group."""
    a = Audit(docs, min_docs=min_docs)
    both = a.pairs().withColumn("part", F.lit("pair")).unionByName(a.terms(top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
