"""Byte-level substring dedup with sparse suffix arrays.

A string of ``size`` bytes goes if it starts at any other place as well. Every
such string has one anchor: the place of its smallest ``K``-byte hash, leftmost
on ties, so equal strings have equal anchors at equal offsets. Consecutive
strings with one anchor make one entry: the anchor's hash and the hash of the
bytes that they span. Then

1. anchors that occur once are done: none of their strings repeats;
2. entries with equal bytes repeat as a whole; one of each stands for them;
3. what is left are places where copies begin, end or differ. Their suffixes
   (the bytes from the anchor on) and reversed prefixes are dealt out by sampled
   splitters over the leading ``K`` bytes, equal leading bytes to one bucket, so
   no match crosses a boundary. A bucket sorts both sides by multikey quicksort,
   eight bytes at a time, and keeps the common-prefix lengths of neighbours: the
   string ``o`` bytes before the anchor repeats if another entry shares the
   block of prefixes common over ``o`` bytes and the block of suffixes common
   over ``size - o`` bytes.

Anchors with more than ``HOT`` different surroundings are not gathered. Each of their
strings is a suffix of its own there, cut to ``size`` bytes: splitters sampled over whole
strings (ties by place) deal them out, a range sorts its strings by the same quicksort and
marks equal neighbours, and the strings at the ends of all ranges are compared across
boundaries, so a string that fills several ranges is seen as well.

Defined cases: a null or empty text has no bytes; texts shorter than ``size``
stay whole; matches never cross documents; repeated rows (same id and text) are
one document; kept bytes may end inside a character and are returned as binary.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import hold, ship, single_key, small_side, width
from cadence.llm.textnp import BASES, U, chunks, merged, mix
from cadence.llm.windows import pack_texts, places

K = 32
HOT = 20_000
#: Text bytes behind each range of suffixes.
RANGE_BYTES = 64 << 20
#: Strings of hot anchors in a range.
RANGE_STRINGS = 100_000
LOW = U(0xFFFFFFFF)
ENTRIES = "key long, pos int, n int, o int, ah long, ch long"


class Prefix:
    """Prefix sums of a polynomial over a buffer: hashes of any of its ranges."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        value = mix(np.arange(256, dtype=U) + U(base))[data]
        up = np.full(max(n, 1), U(base))
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        self.total = np.zeros(n + 1, U)
        np.cumsum(value * up[:n], dtype=U, out=self.total[1:])
        self.down = np.full(n + 1, U(pow(base, -1, 1 << 64)))
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)

    def of(self, s, e) -> np.ndarray:
        return mix((self.total[e] - self.total[s]) * self.down[s])

    def every(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:n]) * self.down[:n])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def entries(size: int):
    def run(batches):
        for key, _, off, data in chunks(batches, 2 << 20):
            per = np.maximum(off[1:] - off[:-1] - size + 1, 0)
            if not per.any():
                continue
            px = Prefix(data, BASES[0])
            h = px.every(K)
            small = window_min((h & ~LOW) | np.arange(len(h), dtype=U), size - K + 1)
            p = places(off[:-1], per)
            a = (small[p] & LOW).astype(np.int64)
            doc = np.repeat(np.arange(len(key)), per)
            cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
            n = np.diff(np.append(cut, len(p)))
            lo, anchor, d = p[cut], a[cut], doc[cut]
            o = anchor - lo
            ch = mix(px.of(lo, lo + n - 1 + size) ^ (o.astype(U) << U(32)) ^ n.astype(U))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[d]),
                    pa.array((lo - off[d]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(o.astype(np.int32)),
                    pa.array(h[anchor].view(np.int64)),
                    pa.array(ch.view(np.int64)),
                ],
                ["key", "pos", "n", "o", "ah", "ch"],
            )

    return run


def contexts(size: int):
    """Packed texts with entries to one row per representative: suffix and reversed prefix."""

    def run(batches):
        for b in batches:
            rows: dict[str, list] = {c: [] for c in ("key", "pos", "n", "o", "whole", "hot", "suffix", "prefix")}
            for key, body, marks in zip(b.column("key").to_pylist(), b.column("body"), b.column("marks").to_pylist()):
                raw = zlib.decompress(body.as_py())
                for m in marks:
                    if m["rep"]:
                        a = m["pos"] + m["o"]
                        for c in ("pos", "n", "o", "whole", "hot"):
                            rows[c].append(m[c])
                        rows["key"].append(key)
                        rows["suffix"].append(raw[a : m["pos"] + m["n"] - 1 + size])
                        rows["prefix"].append(raw[m["pos"] : a][::-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["key"], pa.int64()),
                    *[pa.array(rows[c], pa.int32()) for c in ("pos", "n", "o")],
                    *[pa.array(rows[c], pa.bool_()) for c in ("whole", "hot")],
                    *[pa.array(rows[c], pa.binary()) for c in ("suffix", "prefix")],
                ],
                list(rows),
            )

    return run


CONTEXTS = "key long, pos int, n int, o int, whole boolean, hot boolean, suffix binary, prefix binary"


def multikey_sort(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings (zero-padded to ``length``) and the common-prefix
    length of each with its predecessor. Quicksort by one eight-byte key at a
    time; only runs that are still tied go on to the next key."""
    wide = -(-length // 8) * 8
    m = len(strings)
    keys = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), ">u8").reshape(m, wide // 8)
    order, group = np.arange(m), np.zeros(m, np.int64)
    lcp = np.full(m, wide, np.int64)
    if m:
        lcp[0] = 0
    active = np.arange(m) if m > 1 else np.zeros(0, np.int64)
    for d in range(wide // 8):
        if not len(active):
            break
        k = keys[order[active], d].astype(U)
        o = np.lexsort((k, group[active]))
        order[active], k = order[active][o], k[o]
        g = group[active]
        inside = np.r_[False, g[1:] == g[:-1]]
        differ = k ^ np.r_[U(0), k[:-1]]
        new = inside & (differ != 0)
        at = active[new]
        # equal leading bytes of two different keys
        bits = np.floor(np.log2(differ[new].astype(np.float64))).astype(np.int64)
        exact = differ[new] >> np.minimum(bits, 63).astype(U)
        bits = np.where(exact == 0, bits - 1, bits)
        lcp[at] = 8 * d + (63 - bits) // 8
        start = ~inside | new
        group[active] = active[np.maximum.accumulate(np.where(start, np.arange(len(active)), 0))]
        first = np.flatnonzero(start)
        sizes = np.diff(np.append(first, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
    return order, lcp


def repeated(pos: np.ndarray, n: np.ndarray, o: np.ndarray, suffix: list[bytes], prefix: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and start places of the strings that occur in more than one row."""
    m = len(pos)
    so, sl = multikey_sort(suffix, size)
    po, pl = multikey_sort(prefix, size - K)
    rows, starts = [], []
    for at in range(size - K + 1):
        valid = np.flatnonzero((o >= at) & (o - n < at))
        if len(valid) < 2:
            continue
        right, left = np.empty(m, np.int64), np.empty(m, np.int64)
        right[so] = np.cumsum(sl < size - at)
        left[po] = np.cumsum(pl < at)
        code = left[valid] * (m + 2) + right[valid]
        w = np.argsort(code, kind="stable")
        c = code[w]
        same = c[1:] == c[:-1]
        dup = np.zeros(len(c), bool)
        dup[1:] |= same
        dup[:-1] |= same
        hit = valid[w[dup]]
        rows.append(hit)
        starts.append(pos[hit] + o[hit] - at)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(starts)


def runs_frame(key: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    """One row a document: merged intervals."""
    order = np.lexsort((s, key))
    key, s, e = key[order], s[order], e[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cut, np.append(cut[1:], len(key))):
        x, y = merged(s[a:b], e[a:b])
        out.append(np.stack([x, y]).astype("<u4").tobytes())
    return pd.DataFrame({"rkey": key[cut], "runs": out})


def sort_bucket(size: int):
    """One range partition: gathers its suffixes, yields the repeated strings' runs."""

    def run(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        g = pd.concat(frames, ignore_index=True)
        pos, n, o = (g[c].to_numpy(np.int64) for c in ("pos", "n", "o"))
        rows, starts = repeated(pos, n, o, [bytes(x) for x in g["suffix"]], [bytes(x) for x in g["prefix"]], size)
        open_rows = ~g["whole"].to_numpy(bool)[rows]
        rows, starts = rows[open_rows], starts[open_rows]
        yield runs_frame(g["key"].to_numpy(np.int64)[rows], starts, starts + size)

    return run


def strings(size: int):
    """Suffixes and prefixes of hot anchors to one row per string."""

    def run(batches):
        for b in batches:
            for key, pos, n, suffix, prefix in zip(*(b.column(c).to_pylist() for c in ("key", "pos", "n", "suffix", "prefix"))):
                data = np.frombuffer(prefix[::-1] + suffix, np.uint8)
                body = np.lib.stride_tricks.sliding_window_view(data, size)[:n].tobytes()
                at = pa.py_buffer(np.arange(0, n * size + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(body)]),
                        pa.array(np.full(n, key, np.int64)),
                        pa.array(pos + np.arange(n), pa.int64()),
                    ],
                    ["string", "key", "start"],
                )

    return run


def sort_range(size: int):
    """One range of strings: those with an equal neighbour (``edge`` null), and its
    first and last one (``edge``; ``lone`` if no neighbour of the range is equal)."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        body = t["string"].to_pylist()
        order, lcp = multikey_sort(body, size)
        same = np.append(lcp[1:] >= size, False)
        dup = same | np.r_[False, same[:-1]]
        ends = np.unique([0, len(order) - 1])
        at = np.concatenate([order[dup], order[ends]])
        m = int(dup.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(t["key"].to_numpy()[at]),
                pa.array(t["start"].to_numpy()[at]),
                pa.array([None] * m + [body[i] for i in order[ends]], pa.binary()),
                pa.array(np.concatenate([np.zeros(m, bool), ~dup[ends]])),
            ],
            ["key", "start", "edge", "lone"],
        )

    return run


def hot_hits(reps: DataFrame, size: int, least: int) -> DataFrame:
    """``(key, start)`` of the strings of ``reps`` that occur twice."""
    total = reps.agg(F.sum("n")).first()[0] or 0
    each = reps.mapInArrow(strings(size), "string binary, key long, start long")
    dealt = each.repartitionByRange(max(least, -(-total // RANGE_STRINGS)), "string", "key", "start")
    found = hold(dealt.mapInArrow(sort_range(size), "key long, start long, edge binary, lone boolean"), "suffix-ranges")
    # two rows a range: equal ends lie on both sides of a boundary
    edges = found.filter("edge is not null")
    across = edges.groupBy("edge").agg(F.count("*").alias("c")).filter("c > 1").select("edge")
    lone = edges.filter("lone").join(across, "edge", "left_semi")
    return found.filter("edge is null").select("key", "start").union(lone.select("key", "start"))


def fine_runs(reps: DataFrame, size: int, any_hot: bool, ranges: int) -> DataFrame:
    """``(rkey, runs)`` of representatives that repeat in part, sorted in ``ranges`` buckets."""
    cold = reps.filter("not hot").repartitionByRange(ranges, F.substring("suffix", 1, K))
    found = cold.mapInPandas(sort_bucket(size), "rkey long, runs binary")
    if not any_hot:
        return found
    hot = hold(reps.filter("hot").select("key", "pos", "n", "suffix", "prefix"), "suffix-hot-reps")
    hits = hot_hits(hot, size, ranges).groupBy("key").agg(F.collect_set("start").alias("starts"))

    def to_runs(frames):
        for g in frames:
            for key, starts in zip(g["key"], g["starts"]):
                s = np.asarray(starts, np.int64)
                yield runs_frame(np.full(len(s), key), s, s + size)

    return found.union(hits.mapInPandas(to_runs, "rkey long, runs binary"))


def cut_bytes(size: int):
    def run(batches):
        for b in batches:
            out, total, gone, spans = [], [], [], []
            for body, marks, runs in zip(b.column("body"), b.column("marks").to_pylist(), b.column("runs").to_pylist()):
                raw = zlib.decompress(body.as_py())
                whole = [(m["pos"], m["pos"] + m["n"] - 1 + size) for m in marks or () if m["whole"]]
                more = [np.frombuffer(r, "<u4").reshape(2, -1).astype(np.int64) for r in runs or ()]
                s = np.concatenate([np.array([x[0] for x in whole], np.int64), *[m[0] for m in more]])
                e = np.concatenate([np.array([x[1] for x in whole], np.int64), *[m[1] for m in more]])
                s, e = merged(s, e)
                edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(raw)]
                out.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                total.append(len(raw))
                gone.append(int((e - s).sum()))
                spans.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), *[pa.array(x, pa.int64()) for x in (total, gone, spans)], pa.array(out, pa.binary())],
                ["key", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def dedup_suffixes(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row; ``kept`` is binary."""
    spark = docs.sparkSession
    ship(spark)
    flat, ids = single_key(docs, id_col, text_col)
    unique = flat
    if not flat.groupBy("key").count().filter("count > 1").isEmpty():
        unique = flat.dropDuplicates(["key"])
    every = unique.mapInArrow(entries(size), ENTRIES)
    twice = every.groupBy("ah").agg(F.count("*").alias("c"), F.min("ch").alias("c1"), F.max("ch").alias("c2")).filter("c > 1")
    # written first: a join between two plain exchanges lets Spark split the entries of a hot anchor over many tasks
    twice = hold(twice.select("ah", (F.col("c1") != F.col("c2")).alias("mixed")), "suffix-twice")
    found = hold(every.join(twice, "ah"), "suffix-anchors")
    mixed = found.filter("mixed")
    classes = hold(mixed.groupBy("ah", "ch").agg(F.count("*").alias("c"), F.min(F.struct("key", "pos")).alias("first")), "suffix-classes")
    hot = hold(classes.groupBy("ah").agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select("ah", F.lit(True).alias("hot")), "suffix-hot")
    judged = (
        mixed.join(classes, ["ah", "ch"])
        .join(small_side(hot), "ah", "left")
        .select(
            "key",
            "pos",
            "n",
            "o",
            (F.col("c") > 1).alias("whole"),
            ((F.col("first.key") == F.col("key")) & (F.col("first.pos") == F.col("pos"))).alias("rep"),
            F.coalesce("hot", F.lit(False)).alias("hot"),
        )
        .union(found.filter("not mixed").select("key", "pos", "n", "o", F.lit(True), F.lit(False), F.lit(False)))
    )
    marks = judged.groupBy("key").agg(F.collect_list(F.struct("pos", "n", "o", "whole", "rep", "hot")).alias("marks"))
    texts = flat.mapInArrow(pack_texts, "key long, body binary")
    both = texts.join(marks.withColumnRenamed("key", "mkey"), F.col("key") == F.col("mkey"), "left").select("key", "body", "marks")
    table = hold(both.withColumn("fine", F.coalesce(F.exists("marks", lambda m: m["rep"]), F.lit(False))), "suffix-texts")
    reps = table.filter("fine").select("key", "body", "marks")
    if unique is not flat:
        reps = reps.dropDuplicates(["key"])
    # a place of a text gives one short row at most, and few places do: ranges by the bytes stay small at any size
    total = flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(width(spark), -(-total // RANGE_BYTES))
    fine = fine_runs(reps.mapInArrow(contexts(size), CONTEXTS), size, not hot.isEmpty(), ranges)
    fine = fine.groupBy("rkey").agg(F.collect_list("runs").alias("runs"))
    later = table.filter("fine").join(fine, F.col("key") == F.col("rkey"), "left").select("key", "body", "marks", "runs")
    rest = table.filter("not fine").select("key", "body", "marks", F.lit(None).cast("array<binary>").alias("runs"))
    out = later.union(rest).mapInArrow(cut_bytes(size), "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    if ids is not None:
        out = out.join(ids.withColumnRenamed("key", "ikey"), F.col("key") == F.col("ikey")).drop("key").withColumnRenamed("did", "key")
    return out.select(F.when(F.col("key") != (1 << 63) - 1, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
