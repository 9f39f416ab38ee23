"""Line index: the number of shards follows the distinct keys."""

from cadence.llm import lines


def test_shards_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 50)
    text = lambda a, b: "\n".join(f"a line with the number {i}" for i in range(a, b))
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    state = lambda ix: (
        sorted((bytes(r["key"]).hex(), r["n_docs"], r["first"]["did"]) for r in ix.counts.collect()),
        sorted((r["did"], sorted(r["drop"])) for r in ix.drops().collect()),
    )
    one = lines.LineIndex.empty(spark, 1).insert(docs((1, text(0, 400))))  # one document of many lines
    assert one.shards >= 8
    two = one.insert(docs((2, text(300, 1200))))
    assert two.shards >= 24
    assert state(two) == state(lines.LineIndex.empty(spark, 64).insert(docs((1, text(0, 400)), (2, text(300, 1200)))))
    assert state(two.delete(docs((2, "")).select("doc_id"))) == state(one)
