"""Windows under colliding hashes and many buckets, insertions that repeat, one encoder a worker."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cadence.llm import lines, pieces, queries, windows

SF = "/root/testdata/sf0.001"


def texts():
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 30)) for _ in range(40)]
    return base + [base[3] + " tail", "head " + base[5], base[7], " ".join(base[9].split()[:22]) + " other " + " ".join(base[9].split()[8:])]


def brute(docs, size):
    seen, out = set(), {}
    for i, t in enumerate(docs):
        w = t.split()
        gone = set()
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone |= set(range(p, p + size))
            seen.add(key)
        out[i] = gone
    return out


def through(docs, size, bits, parts):
    """The operator's steps without Spark, so that the hashes can be replaced."""
    key = pa.array(range(len(docs)), pa.int64())
    rows = [r for b in windows.scan(size, bits)([pa.RecordBatch.from_arrays([key, pa.array(docs)], ["key", "text"])]) for r in b.to_pylist()]
    frame = pd.DataFrame(rows)
    late = pd.concat([windows.later_windows(parts)(k, g) for k, g in frame.groupby("bucket")], ignore_index=True)
    out = {i: set() for i in range(len(docs))}
    for _, g in late.groupby("part"):
        for k, runs in windows.document_runs(size)(None, g).itertuples(index=False):
            for s, e in np.frombuffer(runs, "<u4").reshape(2, -1).T.tolist():
                out[k] |= set(range(s, e))
    return out


@pytest.mark.parametrize("bits", [8, 13, 20])
@pytest.mark.parametrize("chunk", [200, 6 << 20])
def test_windows_in_any_number_of_buckets(monkeypatch, bits, chunk):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    docs = texts()
    assert through(docs, 20, bits, 5) == brute(docs, 20)


def test_windows_with_a_first_hash_of_three_values(monkeypatch):
    """Nearly all first hashes collide; the bits of the second one tell windows apart."""
    plain = windows.window_hashes

    def poor(off, data, size):
        h, g, per = plain(off, data, size)
        return h % windows.U(3), g, per

    monkeypatch.setattr(windows, "window_hashes", poor)
    docs = texts()
    for bits in (8, 20):
        found = through(docs, 20, bits, 3)
        want = brute(docs, 20)
        # 16 or 28 bits of the second hash are left: a chance pair is possible with 16
        assert all(found[i] >= want[i] for i in want)
        if bits == 20:
            assert found == want


def test_buckets_follow_the_bytes():
    assert windows.bucket_bits(0, 8) == 8 and windows.bucket_bits(0, 1000) == 10
    assert windows.bucket_bits(100 << 40, 200) == 23
    assert (1 << windows.bucket_bits(5 << 30, 1)) * windows.BUCKET_BYTES >= 5 << 30


def test_inserting_twice_is_inserting_once(spark):
    schema = "doc_id long, text string"
    rows = [(i, f"a line that repeats here\nline number {i} of its own\nline number {i % 3} shared by some") for i in range(30)]
    docs = spark.createDataFrame(rows, schema)
    once = lines.LineIndex.empty(spark, 2).insert(docs)
    more = spark.createDataFrame([(100, "a line that repeats here"), (101, rows[4][1])], schema)
    both = once.insert(more)
    again = both.insert(docs).insert(more.union(docs.limit(7)))

    def state(ix):
        drops = sorted((r.did, tuple(sorted(r["drop"]))) for r in ix.drops().collect())
        counts = sorted((bytes(r.key), r.n_docs, tuple(r["first"])) for r in ix.counts.collect())
        return drops, counts, sorted((bytes(r.key), r.did, r.dh, tuple(sorted(r.ats))) for r in ix.refs.collect())

    assert state(once.insert(docs)) == state(once)
    assert state(again) == state(both)
    assert state(again.delete(more)) == state(once)


def test_a_worker_builds_one_encoder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12).repartition(12)
    pieces.encode_documents(docs, queries.piece_model_path()).collect()

    def look(batches):
        from cadence.llm import pieces as mine

        for b in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [len(mine._READY)], "what": [",".join(f"{k}{id(v)}" for k, v in mine._READY.items())]})

    seen = spark.range(12).repartition(12).mapInArrow(look, "pid long, n long, what string").collect()
    kept = {r.pid: r.what for r in seen if r.n}
    assert kept and all(r.n <= 1 for r in seen)
    pieces.encode_documents(docs, queries.piece_model_path()).collect()
    later = {r.pid: r.what for r in spark.range(12).repartition(12).mapInArrow(look, "pid long, n long, what string").collect() if r.n}
    # workers that live on keep the very object they had
    assert all(later[p] == kept[p] for p in kept.keys() & later.keys()) and kept.keys() & later.keys()
