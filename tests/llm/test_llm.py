"""The training-data operators against brute force, the library they must equal,
held-out labels or SQL, and on edge rows."""

import collections
import hashlib
import os

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadence.llm.common import pick
from cadence.llm import embeddings, lines, mixing, oracle, pieces, quality, queries, rules, simhash, suffixes, toxicity, windows

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"
EDGES = [
    (1, None, "en", "a", 0, "x"),
    (2, "", None, None, None, None),
    (3, " \t\n ", "en", "a", 3, "x"),
    (4, "word " * 60 + "\n" + "A repeated line of text.\n" * 3, "en", "b", 1, "x"),
    (4, "word " * 60 + "\n" + "A repeated line of text.\n" * 3, "en", "b", 1, "x"),
    (5, "  A REPEATED LINE OF TEXT.\t\nshort\nother line, kept here", None, "b", 1, "x"),
    (6, " ".join(f"w{i}" for i in range(300)), "en", "c", 1, "x"),
    (7, "x " + " ".join(f"w{i}" for i in range(10, 300)), "en", None, 1, "x"),
    (None, "no id but a text " * 10, "en", "c", 1, "x"),
    (8, "é" * 5000 + "日本語  😀", "en", "c", 1, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def compare(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    res = con.execute(oracle.oracle_sql()[name])
    at = [[x[0] for x in res.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql(spark, name):
    compare(spark, name)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_mixing_edges(spark, edge, none):
    d = mixing.plan_mix(edge).collect()
    assert len(d) == len(EDGES)
    assert all(r["mix_copies"] in (0, 1, 2) and r["mix_target"] <= 2 * r["mix_source_size"] for r in d)
    assert {r["c0_"]: r["mix_size"] for r in d}[1] == 0
    total = sum(r["mix_size"] for r in d)
    assert sum({r["c3_"]: r["mix_target"] for r in d}.values()) == pytest.approx(1.5 * total)
    out = mixing.mix_sources(edge)
    assert out.columns == edge.columns
    assert out.count() == sum(r["mix_copies"] for r in d)
    assert mixing.mix_sources(none).count() == 0


def test_mixing_takes_about_the_target_of_every_source(spark):
    d = queries.op1_source_mixing(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    for source in {r["source"] for r in d}:
        mine = [r for r in d if r["source"] == source]
        assert len({r["target"] for r in mine}) == 1 and sum(r["size"] for r in mine) == mine[0]["source_size"]
        # one coin a document: four standard deviations at most
        spread = 0.5 * sum(r["size"] ** 2 for r in mine) ** 0.5
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4 * spread
        assert all(r["taken"] <= 2 * r["size"] for r in mine)


def links_brute(fps, radius=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def plain_fingerprint(text, k=3):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    fp = {d: plain_fingerprint(t) for d, t in docs.items()}
    root = links_brute(set(fp.values()))
    first = collections.defaultdict(lambda: 1 << 62)
    for d, f in fp.items():
        first[root[f]] = min(first[root[f]], d)
    got = rows(queries.op3_simhash(spark, SF01))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{f:016x}", first[root[f]]) for d, f in fp.items()}


def test_covering_masks_cover_every_pair():
    import itertools

    masks = simhash.covering_masks((1 << 20) - 1, 3)
    for n in range(4):
        for bits in itertools.combinations(range(20), n):
            x = sum(1 << b for b in bits)
            assert any(not m & x for m in masks)


def test_simhash_splits_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 120:  # a crowd around one fingerprint, and strangers
        x = base
        for b in rng.integers(0, 64, 4):
            x ^= 1 << int(b)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps |= {int(v) for v in rng.integers(-(1 << 62), 1 << 62, 40)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, bound=4).collect()]
    root = {f: f for f in fps}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() >= 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = links_brute(fps)
    assert {f: find(f) for f in fps} == want


def test_simhash_edges(spark, edge, none):
    got = simhash.report(edge).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert {by[d]["fingerprint"] for d in (1, 2, 3)} == {"0" * 16} and {by[d]["component_id"] for d in (1, 2, 3)} == {1}
    kept = simhash.representatives(edge)
    assert kept.columns == edge.columns and [r[0] for r in kept.collect()].count(4) == 1
    assert simhash.report(none).count() == 0 and simhash.representatives(none).count() == 0


def test_windows_edges(spark, edge, none):
    got = windows.dedup_windows(edge).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0
    assert by[4]["n_removed"] == 59  # windows 1 to 40 of "word" cover words 1 to 59; both rows alike
    assert by[6]["n_removed"] == 0 and by[7]["kept"] == "x"
    assert windows.dedup_windows(none).count() == 0


def test_windows_many_texts_under_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"a{i}" for i in range(5, 40))
    got = windows.dedup_windows(spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) in ([0, 25, 30], [0, 25, 35 - 5]) and len(got) == 3


def test_lines_edges(spark, edge, none):
    d = lines.dedup_lines(edge).collect()
    assert len(d) == len(EDGES)
    by = {r["c0_"]: r for r in d}
    assert by[5]["c1_"] == "short\nother line, kept here" and by[5]["ld_dropped"] == 1
    assert by[4]["ld_dropped"] == 0 and by[1]["ld_lines"] == 1 and by[1]["c1_"] is None
    assert lines.dedup_lines(none).count() == 0


def test_line_index_is_reversible(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").distinct()
    old, new = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    one = lines.LineIndex.empty(spark, 4).insert(old)
    both = one.insert(new)
    whole = lines.LineIndex.empty(spark, 4).insert(docs)
    key = lambda ix: sorted((bytes(r["key"]).hex(), r["n_docs"], r["first"]["did"]) for r in ix.counts.collect())
    assert key(both) == key(whole)
    back = both.delete(new.select("doc_id"))
    assert key(back) == key(one)
    drops = lambda ix: sorted((r["did"], sorted(r["drop"])) for r in ix.drops().collect())
    assert drops(back) == drops(one) and drops(both) == drops(whole)
    # every known key answers "maybe" after the deletion
    cells = {r["shard"]: lines.CuckooFilter(1, bytes(r["cells"])) for r in back.filters.collect()}
    for r in back.counts.select(lines._name(F.col("key")).alias("n")).collect():
        x = np.array([r["n"]], np.int64).view(np.uint64)
        assert cells[r["n"] % 4].has(x)[0]


def test_cuckoo_filter():
    x = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = lines.CuckooFilter(len(x))
    assert f.add(x) and f.has(x).all()
    f.remove(x[:2500])
    assert f.has(x[2500:]).all() and f.has(x[:2500]).mean() < 0.01


def test_embeddings_edges(spark):
    v = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    near = [x + 0.01 * (i % 2) for i, x in enumerate(v)]
    data = [(1, v, 0), (2, v, 0), (3, near, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 8, 0), (8, [float("nan")] + v[1:], 0), (9, v[:4], 0), (2, v, 0), (10, [None] + v[1:], 0)]
    got = embeddings.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()
    by = {r["vec_id"]: tuple(r)[1:] for r in got}
    assert len(got) == len(data)
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[3] == (2, 1, False)
    assert all(by[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(empty).count() == 0


def test_embeddings_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 20)
    rng = np.random.default_rng(5)
    c = rng.standard_normal((3, 16))
    x = np.concatenate([c[i % 3] + 0.05 * rng.standard_normal(16) for i in range(150)]).reshape(150, 16).astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    got = rows(embeddings.near_vectors(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")), "vec_id")
    assert [got[i]["n_links"] for i in range(150)] == (near.sum(axis=1) - 1).tolist()


def suffix_brute(docs, size=200):
    seen = collections.Counter(b[i : i + size] for b in docs.values() for i in range(len(b) - size + 1))
    out = {}
    for d, b in docs.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes_brute(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup_suffixes(df).collect()}
    assert got == suffix_brute(docs)


def test_suffix_ranges_compare_across_boundaries(spark, monkeypatch):
    # a range for every few strings: equal strings fill whole ranges and meet at their ends
    monkeypatch.setattr(suffixes, "HOT", 0)
    monkeypatch.setattr(suffixes, "RANGE_STRINGS", 40)
    rng = np.random.default_rng(4)
    core = "".join(rng.choice(list("ab"), 260))
    texts = [core[:230] + str(i) * 30 + core[:210] for i in range(6)] + ["z" * 300 + str(i) for i in range(4)] + [core, core + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup_suffixes(df).collect()}
    assert got == suffix_brute({i: t.encode() for i, t in enumerate(texts)})


@pytest.mark.parametrize("least", [1, 7, 60])
def test_hot_strings_whatever_the_ranges(spark, least):
    rows_ = [(k, 10 * k, 3, b"abcdefg" + bytes([97 + k % 3]) + b"z", b"xy"[: k % 3]) for k in range(30)] + [(99, 0, 1, b"only here", b"")]
    size = 7
    seen = collections.Counter()
    at = collections.defaultdict(list)
    for key, pos, n, suffix, prefix in rows_:
        whole = prefix[::-1] + suffix
        for i in range(n):
            seen[whole[i : i + size]] += 1
            at[whole[i : i + size]].append((key, pos + i))
    df = spark.createDataFrame(rows_, "key long, pos int, n int, suffix binary, prefix binary")
    got = sorted(tuple(r) for r in suffixes.hot_hits(df, size, least).collect())
    assert got == sorted(p for s, c in seen.items() if c > 1 for p in at[s])


def test_suffixes_edges(spark, edge, none):
    # texts that repeat inside themselves, runs of one byte, zero bytes, copies that differ at the ends
    rng = np.random.default_rng(9)
    core = "".join(rng.choice(list("abcdefgh \0é"), 500))
    texts = ["a" * 700, "ab" * 400, core, "x" + core[3:], core[:300] + "Q" + core[301:], core[100:399] + "\0" * 250, "\0" * 230 + core[90:350], "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup_suffixes(df).collect()}
    assert got == suffix_brute({i: (t or "").encode() for i, t in enumerate(texts)})
    again = suffixes.dedup_suffixes(edge).collect()
    assert len(again) == len(EDGES)
    assert suffixes.dedup_suffixes(none).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(2)
    s = [bytes(rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8)) for _ in range(300)]
    order, lcp = suffixes.multikey_sort(s, 30)
    pad = [x.ljust(32, b"\0") for x in s]
    assert [pad[i] for i in order] == sorted(pad)
    for i in range(1, 300):
        assert lcp[i] == len(os.path.commonprefix([pad[order[i - 1]], pad[order[i]]]))


def test_pieces_equal_the_library(spark, edge, none):
    import sentencepiece as spm

    path = queries.piece_model_path()
    sp = spm.SentencePieceProcessor(model_file=path)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for d in (df, edge):
        texts = collections.defaultdict(list)
        for r in d.collect():
            texts[r["doc_id"]].append(r["text"] or "")
        for r in pieces.encode_documents(d, path).collect():
            ids = [sp.encode(t) for t in texts[r["doc_id"]]]
            assert r["ids"] in [",".join(map(str, i)) for i in ids] and r["decoded"] in [sp.decode(i) for i in ids]
    assert pieces.encode_documents(none, path).count() == 0
    e = pieces.Encoder(pieces.load(path))
    rng = np.random.default_rng(4)
    signs = list("abcdehinorst  \n\t▁é日①😀0123.,!XYZ")
    for _ in range(1500):
        t = "".join(rng.choice(signs, rng.integers(0, 40)))
        ids = sp.encode(t)
        assert e.encode(t) == (",".join(map(str, ids)), sp.decode(ids)), repr(t)
        assert e.decode(ids) == sp.decode(ids)


def test_toxicity_held_out(spark, edge, none):
    lab = spark.read.parquet(f"{SF01}/labels.parquet")
    got = queries.op2_toxicity(spark, SF01)
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()
    j = got.filter("held_out").join(lab, "doc_id").select("score", "predicted", "toxic").collect()
    tox = [r["score"] for r in j if r["toxic"]]
    clean = [r["score"] for r in j if not r["toxic"]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in tox for b in clean]) > 0.8
    assert np.mean([r["predicted"] for r in j if not r["toxic"]]) < 0.03
    some = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = toxicity.score_documents(edge, some).collect()
    assert len(d) == len(EDGES) and all(0 <= r["score"] <= 1 for r in d)
    assert toxicity.score_documents(none, some.limit(0)).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(8)
    vec = [{int(t): float(w) for t, w in zip(rng.choice(50, 6, False), rng.random(6))} for _ in range(400)]
    vec = [{t: w / np.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for v in vec]
    ix = toxicity.BlockMaxIndex(list(range(400)), vec, block=16)
    for q in vec[:40]:
        got = [(round(s, 9), int(ix.ids[i])) for s, i in ix.nearest(q, 10)]
        full = sorted(((round(sum(q[t] * v.get(t, 0) for t in q), 9), i) for i, v in enumerate(vec)), key=lambda e: (-e[0], e[1]))[:10]
        assert [s for s, _ in got] == [s for s, _ in full]


def test_quality_classifier_held_out(spark, edge, none):
    lab = spark.read.parquet(f"{SF01}/labels.parquet")
    j = queries.op9_quality_classifier(spark, SF01).join(lab, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in j]) > 0.95
    assert quality.classify(edge).count() == len(EDGES) and quality.classify(none).count() == 0


def test_quality_rules_edges(spark, edge, none):
    d = rules.judge(pick(edge, "doc_id", "text"), F.col("text")).collect()
    by = {r["doc_id"]: r for r in d}
    assert by[1]["qr_base_failed"] and by[3]["qr_n_words"] == 0 and not by[1]["qr_kept"]
    assert by[4]["qr_n_dup_lines"] == 2 and by[4]["qr_n_repeat_words"] == 75
    assert by[6]["qr_kept"]
    out = rules.quality_filter(edge)
    assert out.columns == edge.columns and rules.quality_filter(none).count() == 0
    nav = "Home | Shop | News | Login"
    body = "\n".join(f"Line w{i}a tells w{i}b of w{i}c and w{i}d in w{i}e." for i in range(8))
    page = spark.createDataFrame([(1, nav + "\n" + body), (2, "\n".join([nav + f" {i}" for i in range(9)]) + "\n" + body[:50])], "doc_id long, text string")
    kept = rows(rules.quality_filter(page))
    assert set(kept) == {1} and kept[1]["text"] == body


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    want = collections.Counter(r["doc_id"] for r in at.collect())
    assert collections.Counter(r[0] for r in got) == want
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=queries.piece_model_path())
    for r in at.collect()[:50]:
        ids = sp.encode(r["text"])
        row = (r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert row in got
