"""The whole pipeline against five plain loops, and its defined cases."""

import collections
import hashlib
import math
from fractions import Fraction

import pytest
import regex
import sentencepiece as spm

import corpus_pipeline
from cadence.llm import queries, rules
from tests.llm.test_llm import EDGES, SCHEMA, links_brute, plain_fingerprint

SF = "/root/testdata/sf0.001"
INK = regex.compile(r"[^\x20\x09-\x0D]")
WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def bad(line):
    ink, words = len(INK.findall(line)), len(WORDS.findall(line))
    marks = len(regex.findall(r"[#*$%&|<>!?=_~^\\]", line))
    letters, upper = len(regex.findall(r"\p{L}", line)), len(regex.findall(r"\p{Lu}", line))
    bars = sum(line.count(c) for c in "|»›•→")
    if not regex.search(r"[\p{L}\p{N}]", line) or marks * 100 > ink * 15 or words >= 5 and upper * 100 > letters * 80:
        return True
    if bars >= 2 and bars * 5 >= words:
        return True
    return words <= 40 and any(p in line.lower() for p in rules.BOILERPLATE)


def quality(docs):
    for d in docs:
        text = d["text"] or ""
        w = WORDS.findall(text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
        if len(w) < 20 or 100 * len(covered) > 30 * len(w):
            continue
        lines = text.split("\n")
        stay = [x for x in lines if not INK.search(x) or not bad(x)]
        inked = [x for x in lines if INK.search(x)]
        lost = sum(map(len, lines)) - sum(map(len, stay))
        if lost * 100 <= sum(map(len, inked)) * 40:
            yield d | {"text": "\n".join(stay)}


def line_dedup(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACES))
    holders = collections.defaultdict(set)
    for d in docs:
        for x in d["text"].split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d["doc_id"])
    for d in docs:
        lines = d["text"].split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == d["doc_id"]]
        yield d | {"text": "\n".join(stay)}


def near_dedup(docs):
    fp = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    root = links_brute(set(fp.values()))
    first = {}
    for i, f in sorted(fp.items()):
        first.setdefault(root[f], i)
    return [d for d in docs if first[root[fp[d["doc_id"]]]] == d["doc_id"]]


def mix(docs):
    size = collections.Counter()
    for d in docs:
        size[d["source"]] += len(WORDS.findall(d["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    # fill up: the smallest ceilings for their weight are reached first
    left, target = Fraction(3, 2) * sum(size.values()), {}
    for s in sorted(names, key=lambda s: Fraction(2 * size[s], weight[s])):
        open_weight = sum(weight[t] for t in names if t not in target)
        target[s] = min(Fraction(2 * size[s]), left * weight[s] / open_weight)
        left -= target[s]
    for d in docs:
        rate = float(target[d["source"]] / size[d["source"]]) if size[d["source"]] else 0.0
        coin = int(hashlib.md5(f"17:{d['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        for _ in range(math.floor(rate) + (coin < rate - math.floor(rate))):
            yield d


def test_run_equals_the_plain_loops(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    kept = near_dedup(list(line_dedup(list(quality(docs)))))
    assert 0 < len(kept) < len(docs)
    sp = spm.SentencePieceProcessor(model_file=queries.piece_model_path())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d in mix(kept):
        ids = sp.encode(d["text"])
        want.append((d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_hold_on_edge_rows(spark):
    long = "one two three four five six seven eight nine ten. " * 3
    long = "\n".join(f"{i} {long}{i * 7} and {i * 11} more words of line {i}." for i in range(400))
    more = [(20, "Word " + " ".join(f"a{i}" for i in range(40)) + ".", "en", None, 1, "x"), (21, long, "en", "b", 1, "x")]
    docs = spark.createDataFrame(EDGES + more, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")], name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert not {1, 2, 3} & set(ids) and 20 in ids, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == len(ids) and all(r.n_tokens > 0 for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", 0)] * 3, [(i, "same words here again and again " * 9, "en", "a", 9) for i in range(4)]])
def test_nothing_left_is_an_empty_result(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
