"""Bytes of many documents as one numpy buffer: bounded chunks, words, rolling hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fixed odd multipliers of the 64-bit finalizer and of the two rolling hashes.
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    arr = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(batches, max_bytes: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(key, extra, offsets, bytes)`` of runs of documents of about ``max_bytes``
    (one longer document stays whole), ordered by key inside each. The first
    column is the key, the column ``text`` the text, ``extra`` the rows' numbers
    in the batch."""
    for b in batches:
        off, data = text_bytes(b.column("text"))
        key = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n, i = len(key), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
            j = min(j, n)
            o, d, rows = off[i : j + 1], key[i:j], np.arange(i, j)
            part = data[o[0] : o[-1]]
            o = o - o[0]
            order = np.argsort(d, kind="stable")
            if len(order) > 1 and (order[1:] < order[:-1]).any():
                part = np.concatenate([part[o[k] : o[k + 1]] for k in order]) if len(part) else part
                o = np.concatenate([[0], np.cumsum((o[1:] - o[:-1])[order])])
                d, rows = d[order], rows[order]
            yield d, rows, o, part
            i = j


def packed(text: str | bytes) -> bytes:
    """A text as it travels in a shuffle."""
    return zlib.compress(text.encode() if isinstance(text, str) else text, 1)


def words(off: np.ndarray, data: np.ndarray, ink: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or of the runs of ``ink``) of
    each document and the index of the first word of each (one more entry than documents)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    if ink is None:
        ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, end = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = ink[edge]
    end[edge - 1] = ink[edge - 1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes, eight bytes at a time."""
    size = e - s
    h = mix(size.astype(U) * U(BASES[0]) + U(0x51ED270B + seed))
    if not len(s):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    at = np.flatnonzero(size <= LONG_WORD)
    j = 0
    while len(at):
        left = size[at] - j
        v = lanes[s[at] + j]
        short = left < 8
        v = np.where(short, v & ((U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1)), v)
        h[at] = mix((h[at] ^ v) * U(BASES[1]) + U(j + 1))
        at = at[left > 8]
        j += 8
    for i in np.flatnonzero(size > LONG_WORD):
        raw = blake2b(data[s[i] : e[i]].tobytes(), digest_size=8, key=bytes([seed & 255])).digest()
        h[i] = U(int.from_bytes(raw, "little"))
    return h


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64) of every ``k`` consecutive values, from one
    running sum of ``value * base**i`` and the inverse powers of the odd base."""
    n = len(values)
    if n < k:
        return np.zeros(0, U)
    up = np.full(n, U(base))
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    total = np.zeros(n + 1, U)
    np.cumsum(values * up, dtype=U, out=total[1:])
    down = np.full(n - k + 1, U(pow(base, -1, 1 << 64)))
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    return mix((total[k:] - total[: n - k + 1]) * down)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal, disjoint, non-touching ones."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, reach = starts[o], np.maximum.accumulate(ends[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return s[at], np.append(reach[at[1:] - 1], reach[-1])
