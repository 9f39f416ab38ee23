"""Substring dedup by Rabin-Karp windows of words.

Every window of ``size`` consecutive words of a document gets two rolling 64-bit
hashes. Inside a task a repeated window keeps its earliest place only (a window
that a third of all documents hold costs one entry a chunk); what is left is
packed by the leading bits of the second hash and compared per bucket. The
earliest place of a window stays, all other windows go; their words, merged into
maximal intervals, are removed.

Buckets (and document groups) follow the counted bytes of the input, one for
``BUCKET_BYTES`` of text, so a bucket stays within a task's memory at any size. Two
windows are taken as equal if the whole first hash, the bucket's ``b`` bits and
eight further bits of the second hash are: among N windows about
``N**2 / 2**(73 + b)`` pairs agree by chance (100 TB, N = 1e13 and b = 23: 0.0013).

Defined cases: a null, empty or blank text has no words; fewer words than a
window leave the text whole; repeated rows (same id and text) are one document
and keep the same words, different texts under one id are ordered by their
hashes; an empty table gives an empty result; a null id is ordered last.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadence.llm.common import ship, single_key, width
from cadence.llm.textnp import BASES, U, chunks, merged, mix, packed, rolling, text_bytes, word_hashes, words

CHUNK = 6 << 20
BUCKET_BYTES = 16 << 20
PACKED = "bucket int, n int, hashes binary, places binary, keys binary, counts binary"


def window_hashes(off: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every window inside one document, and the windows per document."""
    s, e, first = words(off, data)
    w = word_hashes(data, s, e)
    per = np.maximum(first[1:] - first[:-1] - size + 1, 0)
    at = places(first[:-1], per)
    return rolling(w, size, BASES[0])[at], rolling(mix(w), size, BASES[1])[at], per


def places(begin: np.ndarray, per: np.ndarray) -> np.ndarray:
    """``begin[i] .. begin[i] + per[i] - 1`` for all ``i``, one after the other."""
    total = np.cumsum(per)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - total + per, per)


def bucket_bits(text_bytes_: int, partitions: int) -> int:
    """Leading bits of the second hash that name a bucket: a bucket for ``BUCKET_BYTES``
    of text, at least as many as tasks, and 256."""
    return max(8, (max(partitions, -(-text_bytes_ // BUCKET_BYTES)) - 1).bit_length())


def grouped(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``(h, check)``, places as they come, and where a new pair begins."""
    order = np.argsort(h, kind="stable")
    hs, cs = h[order], check[order]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    if (~new[1:] & (cs[1:] != cs[:-1])).any():
        order = np.lexsort((check, h))
        hs, cs = h[order], check[order]
        new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    return order, new


def ascending(x: np.ndarray) -> bytes:
    """Ascending numbers as gaps of one byte, 255 standing for a longer gap stored behind."""
    gap = np.diff(x, prepend=0)
    return np.minimum(gap, 255).astype(np.uint8).tobytes() + gap[gap >= 255].astype("<i8").tobytes()


def from_ascending(raw: bytes, n: int) -> np.ndarray:
    gap = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    gap[gap == 255] = np.frombuffer(raw, "<i8", offset=n)
    return np.cumsum(gap)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    names = ["bucket", "n", "hashes", "places", "keys", "counts"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def scan(size: int, bits: int):
    """Chunks of documents to packed rows: windows by bucket, and (``n`` negative)
    places already known to be later ones."""
    buckets = 1 << bits

    def run(batches):
        for key, _, off, data in chunks(batches, CHUNK):
            h, g, per = window_hashes(off, data, size)
            if not len(h):
                continue
            # documents that repeat a row before them are left to it
            doc = np.repeat(np.arange(len(key)), per)
            at = places(np.zeros(len(per), np.int64), per)
            order, new = grouped(h, g)
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            late = order[(key[doc[head]] != key[doc[order]]) | (at[head] != at[order])]
            if len(late):
                late.sort()
                k = key[doc[late]].astype("<i8")
                yield _batch([(int(k[0]) % buckets, -len(late), b"", at[late].astype("<u4").tobytes(), k.tobytes(), b"")])
            keep = order[new]
            bucket = (g[keep] >> U(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16)
            by = np.argsort(bucket, kind="stable")
            keep, bucket = keep[by], bucket[by]
            full_at = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + 1))
            ends = np.append(full_at[1:], len(bucket))
            full = np.flatnonzero(per)
            rank = np.zeros(len(key), np.int64)
            rank[full] = np.arange(len(full))
            rows = []
            for b, i, j in zip(bucket[full_at].tolist(), full_at.tolist(), ends.tolist()):
                x = np.sort(keep[i:j])
                body = h[x].astype("<u8").tobytes() + (g[x] >> U(56 - bits)).astype(np.uint8).tobytes()
                d = doc[x]
                held = np.flatnonzero(np.diff(d, prepend=-1))  # first window of each document in this bucket
                counts = np.diff(held, append=len(x)).astype("<u4")
                small = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()
                rows.append((b, len(x), body, at[x].astype("<u4").tobytes() if at[x].max() > 65535 else at[x].astype("<u2").tobytes(), ascending_keys(key[d[held]]), small))
                if len(rows) == 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def ascending_keys(x: np.ndarray) -> bytes:
    """Count, first key and gaps of ascending keys of any sign."""
    return np.int64(len(x)).tobytes() + np.int64(x[0]).tobytes() + ascending(x[1:] - x[0])


def from_ascending_keys(raw: bytes) -> np.ndarray:
    n, first = np.frombuffer(raw, "<i8", 2)
    return np.concatenate([[first], first + from_ascending(raw[16:], int(n) - 1)])


def unpack(g: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of one bucket: hash, check bits, key and place of its windows; key and place of known later ones."""
    hs, cs, ks, ats, lk, la = [], [], [], [], [], []
    for n, hashes, place, keys, counts in zip(g["n"], g["hashes"], g["places"], g["keys"], g["counts"]):
        if n < 0:
            lk.append(np.frombuffer(keys, "<i8"))
            la.append(np.frombuffer(place, "<u4"))
            continue
        hs.append(np.frombuffer(hashes, "<u8", n))
        cs.append(np.frombuffer(hashes, np.uint8, offset=8 * n))
        k = from_ascending_keys(keys)
        c = np.frombuffer(counts, np.uint8, len(k)).astype(np.int64)
        c[c == 255] = np.frombuffer(counts, "<u4", offset=len(k))
        ks.append(np.repeat(k, c))
        ats.append(np.frombuffer(place, "<u2" if len(place) == 2 * n else "<u4").astype(np.uint32))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(hs, U), cat(cs, np.uint8), cat(ks, np.int64), cat(ats, np.uint32), cat(lk, np.int64), cat(la, np.uint32)


def later_windows(parts: int):
    """Bucket rows to the places of windows that also start earlier, packed by document group."""

    def run(_, g: pd.DataFrame) -> pd.DataFrame:
        h, c, k, at, late_k, late_at = unpack(g)
        if len(h):
            o, new = grouped(h, c)
            dup = ~new
            dup[:-1] |= ~new[1:]
            o = o[dup]
            o = o[np.lexsort((at[o], k[o], c[o], h[o]))]
            hs, cc, kk, aa = h[o], c[o], k[o], at[o]
            new = np.ones(len(o), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (cc[1:] != cc[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
            later = (kk != kk[head]) | (aa != aa[head])
            late_k, late_at = np.concatenate([late_k, kk[later]]), np.concatenate([late_at, aa[later]])
        part = (late_k.view(np.uint64) * U(BASES[1]) >> U(33)).astype(np.int64) % parts
        o = np.lexsort((late_at, late_k, part))
        part, late_k, late_at = part[o], late_k[o], late_at[o]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cut[1:], len(part))
        return pd.DataFrame(
            {
                "part": part[cut].astype(np.int32),
                "keys": [late_k[a:b].tobytes() for a, b in zip(cut, ends)],
                "places": [late_at[a:b].astype("<u4").tobytes() for a, b in zip(cut, ends)],
            }
        )

    return run


def document_runs(size: int):
    """Places of a document group to one row a document: merged word intervals."""

    def run(_, g: pd.DataFrame) -> pd.DataFrame:
        k = np.concatenate([np.frombuffer(x, "<i8") for x in g["keys"]])
        at = np.concatenate([np.frombuffer(x, "<u4") for x in g["places"]]).astype(np.int64)
        o = np.lexsort((at, k))
        k, at = k[o], at[o]
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(k))):
            s, e = merged(at[a:b], at[a:b] + size)
            out.append(np.stack([s, e]).astype("<u4").tobytes())
        return pd.DataFrame({"rkey": k[cut], "runs": out})

    return run


def removed_runs(docs: DataFrame, size: int = 20) -> DataFrame:
    """``(rkey, runs)``: per document that loses words the maximal word intervals."""
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(total, width(spark))
    # a document loses most of its words at worst: groups as many as buckets hold them
    parts = max(width(spark), -(-total // BUCKET_BYTES))
    rows = docs.mapInArrow(scan(size, bits), PACKED)
    late = rows.groupBy("bucket").applyInPandas(later_windows(parts), "part int, keys binary, places binary")
    return late.groupBy("part").applyInPandas(document_runs(size), "rkey long, runs binary")


def pack_texts(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(t.as_py()) for t in b.column("text")], pa.binary())], ["key", "body"])


def cut_words(batches):
    """Texts without the removed words, kept words joined by one space."""
    for b in batches:
        out, total, gone = [], [], []
        for body, runs in zip(b.column("body"), b.column("runs")):
            w = zlib.decompress(body.as_py()).split()
            total.append(len(w))
            cut = runs.as_py()
            if cut is None:
                gone.append(0)
            else:
                n = 0
                for s, e in np.frombuffer(cut, "<u4").reshape(2, -1).T[::-1].tolist():
                    del w[s:e]
                    n += e - s
                gone.append(n)
            out.append(b" ".join(w).decode())
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())],
            ["key", "n_words", "n_removed", "kept"],
        )


def dedup_windows(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row of ``docs``."""
    flat, ids = single_key(docs, id_col, text_col)
    runs = removed_runs(flat, size)
    texts = flat.mapInArrow(pack_texts, "key long, body binary")
    both = texts.join(runs, texts.key == runs.rkey, "left").select("key", "body", "runs")
    out = both.mapInArrow(cut_words, "key long, n_words long, n_removed long, kept string")
    if ids is not None:
        out = out.join(ids, "key").withColumnRenamed("did", "key0").drop("key").withColumnRenamed("key0", "key")
    return out.select(F.when(F.col("key") != (1 << 63) - 1, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept")
