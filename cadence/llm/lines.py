"""Line dedup: sharded cuckoo filters in front of exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lowered; its MD5
is the key's name. The index keeps two exact tables in the shared folder,

* ``refs``: one row per document and key, with the numbers of its lines, and
* ``counts``: one row per key with the number of documents that hold it and the
  smallest of them,

and per shard of the keys a cuckoo filter. A new batch is first counted by key,
so a line that a third of all documents hold is one row; only keys that the
filter may know are looked up in ``counts``, all others are new; every key of
``counts`` has a mark of its own, also one whose mark was there before. Deleting
documents takes their ``refs`` away, recounts the keys they held and removes
the keys nobody holds any more from the filter, so a deletion undoes an
insertion exactly. Both append segments: an insertion writes its own references,
its own keys and the filters of their shards, a deletion the ids, the recounted keys
and the filters of the lost ones; more than ``SEGMENTS`` segments are merged. A filter that would overflow is rebuilt twice as large from
the exact keys of its shard; it never answers "new" for a known key. Shards follow
the number of distinct keys: an insertion that would bring more than
``KEYS_PER_SHARD`` keys to a shard first deals the known keys to more shards.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; a line repeated inside its first
document stays; repeated rows are one document; a null id is ordered last.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadence.llm.common import hold, keyed, ship, width

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4
KEYS_PER_SHARD = 200_000
#: Segments of a table before they are merged into one.
SEGMENTS = 8


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit names: 16-bit marks, four slots a bucket."""

    def __init__(self, capacity: int, table: bytes | None = None):
        need = max(2, -(-int(capacity * 1.25) // SLOTS))
        self.n = 1 << (need - 1).bit_length()
        if table is None:
            self.table = np.zeros((self.n, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
            self.n = len(self.table)

    @staticmethod
    def _mark(names: np.ndarray) -> np.ndarray:
        return ((names >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.n - 1)

    def _places(self, names: np.ndarray):
        mark = self._mark(names)
        one = (names * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(self.n - 1)
        return mark, one.astype(np.int64), (one ^ self._jump(mark)).astype(np.int64)

    def has(self, names: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(names)
        return (self.table[one] == mark[:, None]).any(axis=1) | (self.table[two] == mark[:, None]).any(axis=1)

    def add(self, names: np.ndarray) -> bool:
        """False if the table is too full; the caller then rebuilds it larger."""
        mark, one, two = self._places(names)
        jumps = self._jump(mark).astype(np.int64)
        t, rest = self.table, np.arange(len(names))
        # settle those that find a free slot, one per bucket and round
        for where in (one, two):
            for slot in range(SLOTS):
                if not len(rest):
                    break
                free = t[where[rest], slot] == 0
                first = np.zeros(len(rest), bool)
                first[np.unique(where[rest], return_index=True)[1]] = True
                take = rest[free & first]
                t[where[take], slot] = mark[take]
                rest = rest[~(free & first)]
        for i in rest.tolist():
            m, b, j = int(mark[i]), int(one[i]), int(jumps[i])
            for kick in range(500):
                row = t[b]
                gap = np.flatnonzero(row == 0)
                if len(gap):
                    row[gap[0]] = m
                    break
                s = (m + kick) % SLOTS
                m, row[s] = int(row[s]), m
                j = int(self._jump(np.array([m], np.uint16))[0])
                b = b ^ j
            else:
                return False
        return True

    def remove(self, names: np.ndarray) -> None:
        """Takes one copy of each name's mark away; only names that were added."""
        for m, one, two in zip(*(x.tolist() for x in self._places(names))):
            for b in (one, two):
                at = np.flatnonzero(self.table[b] == m)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    def bytes(self) -> bytes:
        return self.table.tobytes()


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def doc_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(key, did, dh, at)`` per line whose key is long enough; ``docs`` is keyed."""
    each = docs.select("did", "dh", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    key = each.select("did", "dh", "at", line_key(F.col("line")).alias("k")).filter(F.length("k") >= min_chars)
    return key.select(F.unhex(F.md5("k")).alias("key"), "did", "dh", "at")


def _name(key: Column) -> Column:
    """64-bit name of a key for the filters."""
    return F.xxhash64(key)


def _latest(parts: tuple[DataFrame, ...], key: str) -> DataFrame:
    """The row of the last segment for each key; keys do not repeat inside a segment."""
    if len(parts) == 1:
        return parts[0]
    rest = [c for c in parts[0].columns if c != key]
    each = [p.select(key, F.struct(F.lit(i).alias("at_"), *rest).alias("r")) for i, p in enumerate(parts)]
    return reduce(DataFrame.union, each).groupBy(key).agg(F.max("r").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


@dataclass(frozen=True)
class LineIndex:
    """Written state. Its tables only grow: a change appends a segment with the rows
    it touches, and rows of a later segment stand for the earlier ones of their key."""

    #: ``(change, segment)`` each: new references, ids of deleted documents
    ref_parts: tuple[tuple[int, DataFrame], ...]
    gone_parts: tuple[tuple[int, DataFrame], ...]
    count_parts: tuple[DataFrame, ...]
    filter_parts: tuple[DataFrame, ...]
    shards: int
    min_chars: int = 10
    #: Insertions and deletions so far.
    changes: int = 0

    @staticmethod
    def empty(spark: SparkSession, shards: int, min_chars: int = 10) -> "LineIndex":
        return LineIndex(
            ((0, spark.createDataFrame([], "key binary, did long, dh long, ats array<int>")),),
            (),
            (spark.createDataFrame([], "key binary, n_docs long, first struct<did:long,dh:long>"),),
            (spark.createDataFrame([], "shard int, cells binary"),),
            shards,
            min_chars,
        )

    @property
    def refs(self) -> DataFrame:
        """One row per document and key, without the deleted documents."""
        live = []
        for at, part in self.ref_parts:
            for later, gone in self.gone_parts:
                if later > at:
                    part = part.join(gone, "did", "left_anti")
            live.append(part.select("key", "did", "dh", "ats"))
        return reduce(DataFrame.union, live)

    @property
    def counts(self) -> DataFrame:
        """One row per key that some document holds."""
        return _latest(self.count_parts, "key").filter("n_docs > 0")

    @property
    def filters(self) -> DataFrame:
        """One filter per shard."""
        return _latest(self.filter_parts, "shard")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """The index after adding documents; those that it holds already (same id,
        same text) change nothing."""
        new = keyed(docs, id_col, text_col)
        if self.changes:
            new = new.join(self.refs.select("did", "dh").distinct(), ["did", "dh"], "left_anti")
        fresh = hold(
            doc_lines(new, self.min_chars)
            .groupBy("key", "did", "dh")
            .agg(F.collect_set("at").alias("ats")),
            "line-refs",
        )
        batch = fresh.groupBy("key").agg(F.count("*").alias("n_docs"), F.min(F.struct("did", "dh")).alias("first"))
        batch = hold(batch, "line-batch")
        # written tables: their counts are read from the files' footers
        shards = -(-(batch.count() + sum(p.count() for p in self.count_parts)) // KEYS_PER_SHARD)
        if shards > self.shards:
            return self._resharded(max(shards, 2 * self.shards))._insert(fresh, batch)
        return self._insert(fresh, batch)

    def _resharded(self, shards: int) -> "LineIndex":
        """The same index with its keys in more shards."""
        wider = replace(self, shards=shards)
        if not self.changes:
            return wider
        return replace(wider, filter_parts=(hold(wider._rebuilt(self.counts), "line-filters"),))

    def _insert(self, fresh: DataFrame, batch: DataFrame) -> "LineIndex":
        grown = hold(self._probe(batch.select(_name(F.col("key")).alias("name"))), "line-filters")
        filters = grown.filter("length(cells) > 0").select("shard", "cells")
        full = grown.filter("cells is not null and length(cells) = 0").select("shard")
        known = grown.filter("cells is null").select("name")
        counts = batch.select("key", "n_docs", "first")
        if not known.isEmpty():
            # only keys that the filter may know meet the exact table
            maybe = batch.join(known, _name(F.col("key")) == known.name, "left_semi").select("key")
            old = hold(self.counts.join(maybe, "key", "left_semi"), "line-known")
            merged = counts.union(old).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first"))
            counts = hold(merged, "line-counts")
            # keys that the filter only seemed to know get marks of their own
            wrong = maybe.join(old, "key", "left_anti").select(_name(F.col("key")).alias("name"))
            mended = hold(self._marked(filters, wrong), "line-filters")
            full = full.union(mended.filter("length(cells) = 0").select("shard"))
            filters = mended.filter("length(cells) > 0")
        after = self._appended(counts=counts, refs=fresh)
        if not full.isEmpty():
            # some filters are full: at most one row a shard names them
            filters = hold(filters.union(self._rebuilt(after.counts, full)), "line-filters")
        return after._appended(filters=filters)._merged()

    def _appended(self, refs: DataFrame | None = None, gone: DataFrame | None = None, counts: DataFrame | None = None, filters: DataFrame | None = None) -> "LineIndex":
        """The index with further segments; counts come with every change, filters after them."""
        now = self.changes + (counts is not None)

        def more(parts: tuple, part) -> tuple:
            if part is None:
                return parts
            # the empty tables of a new index give way
            return (part,) if now == 1 else parts + (part,)

        return replace(
            self,
            changes=now,
            ref_parts=more(self.ref_parts, None if refs is None else (now, refs)),
            gone_parts=more(self.gone_parts, None if gone is None else (now, gone)),
            count_parts=more(self.count_parts, counts),
            filter_parts=more(self.filter_parts, filters),
        )

    def _merged(self) -> "LineIndex":
        """Tables of more than ``SEGMENTS`` segments become one segment each."""
        out = self
        if len(self.count_parts) > SEGMENTS:
            out = replace(out, count_parts=(hold(self.counts, "line-counts"),))
        if len(self.filter_parts) > SEGMENTS:
            out = replace(out, filter_parts=(hold(self.filters, "line-filters"),))
        if len(self.ref_parts) + len(self.gone_parts) > SEGMENTS:
            out = replace(out, ref_parts=((self.changes, hold(self.refs, "line-refs")),), gone_parts=())
        return out

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> "LineIndex":
        """The index as if the documents with these ids had never been inserted."""
        gone = hold(ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("did")).distinct(), "line-gone")
        refs = self.refs
        touched = hold(refs.join(gone, "did", "left_semi").select("key").distinct(), "line-touched")
        again = refs.join(gone, "did", "left_anti").join(touched, "key", "left_semi").groupBy("key").agg(
            F.count("*").alias("n_docs"), F.min(F.struct("did", "dh")).alias("first")
        )
        counts = touched.join(again, "key", "left").select("key", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), "first")
        counts = hold(counts, "line-counts")
        lost = counts.filter("n_docs = 0").select(_name(F.col("key")).alias("name"))

        def shrink(key, cells: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
            if not len(cells) or not len(names):
                return pd.DataFrame({"shard": [], "cells": []}).astype({"shard": "int32"})
            f = CuckooFilter(1, bytes(cells["cells"].iloc[0]))
            f.remove(names["name"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": np.array([key[0]], np.int32), "cells": [f.bytes()]})

        filters = self._touched(lost).groupBy("shard").cogroup(self._sharded(lost).groupBy("shard")).applyInPandas(shrink, "shard int, cells binary")
        return self._appended(gone=gone, counts=counts, filters=hold(filters, "line-filters"))._merged()

    def _touched(self, names: DataFrame) -> DataFrame:
        """The filters of the shards that the names belong to."""
        if not self.changes:
            return self.filters
        return self.filters.join(self._sharded(names).select("shard").distinct(), "shard", "left_semi")

    def _probe(self, names: DataFrame) -> DataFrame:
        """Per shard the grown filter (``cells``) and the names it may have held before."""
        ship(names.sparkSession)

        def grow(key, cells: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            x = new["name"].to_numpy(np.int64).view(np.uint64)
            f = CuckooFilter(len(x), bytes(cells["cells"].iloc[0]) if len(cells) else None)
            held = f.has(x) if len(cells) else np.zeros(len(x), bool)
            done = f.add(x[~held])
            if not done:
                held = np.ones(len(x), bool)  # the exact table decides
            known = x[held].view(np.int64).tolist()
            return pd.DataFrame(
                {
                    "shard": np.full(len(known) + 1, key[0], np.int32),
                    "name": pd.array([None] + known, "Int64"),
                    "cells": [f.bytes() if done else b""] + [None] * len(known),
                }
            )

        return self._touched(names).groupBy("shard").cogroup(self._sharded(names).groupBy("shard")).applyInPandas(
            grow, "shard int, name long, cells binary"
        )

    def _marked(self, filters: DataFrame, names: DataFrame) -> DataFrame:
        """The filters with marks of the names added, whatever they answer for them;
        empty ``cells`` for a filter that is full."""

        def mark(key, cells: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            if not len(cells):  # full already
                return pd.DataFrame({"shard": [], "cells": []}).astype({"shard": "int32"})
            f = CuckooFilter(1, bytes(cells["cells"].iloc[0]))
            done = f.add(new["name"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"shard": np.array([key[0]], np.int32), "cells": [f.bytes() if done else b""]})

        return filters.groupBy("shard").cogroup(self._sharded(names).groupBy("shard")).applyInPandas(mark, "shard int, cells binary")

    def _sharded(self, names: DataFrame) -> DataFrame:
        return names.withColumn("shard", F.pmod("name", F.lit(self.shards)).cast("int"))

    def _rebuilt(self, counts: DataFrame, shards: DataFrame | None = None) -> DataFrame:
        """Filters of the given shards (all) anew from the exact keys, with room to double."""
        names = self._sharded(counts.select(_name(F.col("key")).alias("name")))
        if shards is not None:
            names = names.join(F.broadcast(shards), "shard", "left_semi")

        def build(key, rows: pd.DataFrame) -> pd.DataFrame:
            x = rows["name"].to_numpy(np.int64).view(np.uint64)
            size = 2 * len(x)
            f = CuckooFilter(size)
            while not f.add(x):
                size *= 2
                f = CuckooFilter(size)
            return pd.DataFrame({"shard": np.array([key[0]], np.int32), "cells": [f.bytes()]})

        return names.groupBy("shard").applyInPandas(build, "shard int, cells binary")

    def drops(self) -> DataFrame:
        """``(did, dh, drop)``: numbers of the lines that each document loses."""
        shared = self.counts.filter("n_docs > 1").select("key", "first")
        # different texts under one id are one holder for the rule "smallest id holding it"
        late = self.refs.join(shared, "key").filter(F.col("first.did") != F.col("did"))
        return late.groupBy("did", "dh").agg(F.flatten(F.collect_list("ats")).alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (columns by position, ``c0_`` ...) with shortened texts and the
    columns ``ld_lines`` (before) and ``ld_dropped``."""
    index = LineIndex.empty(docs.sparkSession, width(docs.sparkSession), min_chars).insert(docs, id_col, text_col)
    names = [f"c{i}_" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]
    flat = docs.toDF(*names)
    text = F.coalesce(F.col(at), F.lit(""))
    mine = flat.withColumn("ld_did", F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit((1 << 63) - 1)))
    mine = mine.withColumn("ld_dh", F.xxhash64(text))
    cut = index.drops().toDF("r_did", "r_dh", "ld_drop")
    both = mine.join(cut, (F.col("ld_did") == F.col("r_did")) & (F.col("ld_dh") == F.col("r_dh")), "left")
    both = both.withColumn("ld_all", F.split(text, "\n")).withColumn("ld_lines", F.size("ld_all").cast("long"))
    places = F.array_except(F.sequence(F.lit(0), F.size("ld_all") - 1), F.col("ld_drop"))
    kept = F.array_join(F.transform(places, lambda i: F.get("ld_all", i)), "\n")
    both = both.withColumn("ld_dropped", F.coalesce(F.size("ld_drop"), F.lit(0)).cast("long"))
    both = both.withColumn("ld_dropped", F.greatest("ld_dropped", F.lit(0).cast("long")))
    both = both.withColumn(at, F.when(F.col("ld_dropped") > 0, kept).otherwise(F.col(at)))
    return both.select(*names, "ld_lines", "ld_dropped")
