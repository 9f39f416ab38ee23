"""Line index: keys that share a filter mark stay exact through insertions and deletions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import lines


@pytest.fixture(scope="module")
def collision(spark):
    """Two lines whose names have equal marks and buckets in a filter of two buckets."""
    texts = [f"line number {i:06d} of the search" for i in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = [r["n"] for r in df.select(lines._name(F.unhex(F.md5(lines.line_key(F.col("t"))))).alias("n")).collect()]
    mark, one, two = lines.CuckooFilter(1)._places(np.array(names, np.int64).view(np.uint64))
    seen = {}
    for t, m, a, b in zip(texts, mark.tolist(), one.tolist(), two.tolist()):
        if (m, min(a, b), max(a, b)) in seen:
            return seen[(m, min(a, b), max(a, b))], t
        seen[(m, min(a, b), max(a, b))] = t
    raise AssertionError("no collision among the lines")


@pytest.mark.parametrize("gone", [1, 2])
def test_shared_marks(spark, collision, gone):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    state = lambda ix: (
        sorted((bytes(r["key"]).hex(), r["n_docs"], r["first"]["did"]) for r in ix.counts.collect()),
        sorted((r["did"], sorted(r["drop"])) for r in ix.drops().collect()),
    )
    a, b = collision
    both = lines.LineIndex.empty(spark, 1).insert(docs((1, a))).insert(docs((2, b)))
    left = both.delete(docs((gone, "")).select("doc_id"))
    kept = {1: b, 2: a}[gone]
    got = left.insert(docs((3, kept)))
    fresh = lines.LineIndex.empty(spark, 1).insert(docs((3 - gone, kept), (3, kept)))
    assert state(got) == state(fresh)
    assert len(state(got)[0]) == 1 and state(got)[1] == [(3, [0])]
