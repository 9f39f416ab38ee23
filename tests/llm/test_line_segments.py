"""Line index: a change writes the rows it touches, and many changes merge to the same state."""

from cadence.llm import lines


def state(ix):
    return (
        sorted((bytes(r["key"]).hex(), r["n_docs"], r["first"]["did"]) for r in ix.counts.collect()),
        sorted((bytes(r["key"]).hex(), r["did"], sorted(r["ats"])) for r in ix.refs.collect()),
        sorted((r["did"], sorted(r["drop"])) for r in ix.drops().collect()),
    )


def test_a_change_writes_what_it_touches(spark):
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    text = lambda a, b: "\n".join(f"a line with the number {i}" for i in range(a, b))
    big = lines.LineIndex.empty(spark, 16).insert(docs((1, text(0, 400)), (2, text(200, 600))))
    assert [len(x) for x in (big.ref_parts, big.count_parts, big.filter_parts)] == [1, 1, 1]
    more = big.insert(docs((3, text(599, 601))))  # one known line, one new line
    assert more.ref_parts[-1][1].count() == 2
    assert more.count_parts[-1].count() == 2
    assert 1 <= more.filter_parts[-1].count() <= 2 < more.filters.count()
    assert more.count_parts[0] is big.count_parts[0] and more.ref_parts[0] is big.ref_parts[0]
    assert state(more) == state(lines.LineIndex.empty(spark, 16).insert(docs((1, text(0, 400)), (2, text(200, 600)), (3, text(599, 601)))))
    back = more.delete(docs((3, "")).select("doc_id"))
    assert back.count_parts[-1].count() == 2 and back.gone_parts[-1][1].count() == 1
    assert back.filter_parts[-1].count() == 1  # one key is lost
    assert state(back) == state(big)
    again = back.insert(docs((3, text(599, 601))))  # a deleted document may come back
    assert state(again) == state(more)


def test_many_changes_merge(spark, monkeypatch):
    monkeypatch.setattr(lines, "SEGMENTS", 2)
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    text = lambda a, b: "\n".join(f"a line with the number {i}" for i in range(a, b))
    ix = lines.LineIndex.empty(spark, 2)
    for i in range(4):
        ix = ix.insert(docs((i, text(10 * i, 10 * i + 20))))
        if i == 1:
            ix = ix.delete(docs((0, "")).select("doc_id"))
    assert max(len(ix.count_parts), len(ix.filter_parts), len(ix.ref_parts) + len(ix.gone_parts)) <= 2
    whole = lines.LineIndex.empty(spark, 2).insert(docs(*[(i, text(10 * i, 10 * i + 20)) for i in (1, 2, 3)]))
    assert state(ix) == state(whole)
