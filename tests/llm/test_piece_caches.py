"""What an encoder remembers stays within its bounds, and small bounds change no result."""

import sys

import numpy as np
import pytest
import sentencepiece as spm

from cadence.llm import pieces, queries

LETTERS = np.array(list("abcdehinorstéд"))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(pieces, "PAIRS", 500, raising=False)
    return pieces.load(queries.piece_model_path())


def held(e):
    return sum(sys.getsizeof(w) + sys.getsizeof(x) for cache in (e.ids_of, e.ids_of.older) for w, x in cache.items())


def made_up(rng, most):
    return "".join(rng.choice(LETTERS, rng.integers(3, most)))


def test_caches_are_bounded_by_bytes(small):
    sp = spm.SentencePieceProcessor(model_file=queries.piece_model_path())
    e, rng = pieces.Encoder(small), np.random.default_rng(3)
    often = [made_up(rng, 9) for _ in range(50)]
    for _ in range(40):
        words = [made_up(rng, 14) for _ in range(100)] + [made_up(rng, 3_000)] + list(rng.choice(often, 60))
        text = " ".join(rng.permutation(words)) + " " * int(rng.integers(0, 30))
        ids = sp.encode(text)
        assert e.encode(text) == (",".join(map(str, ids)), sp.decode(ids))
        assert held(e) <= 2 << 16 and len(e.pairs) <= 500
    e.encode(" " * 5_000 + "x")
    assert 5_000 not in e.runs and 5_001 not in e.runs


def test_odd_words_outlive_the_caches_within_a_text(small):
    # without byte pieces, words with unknown signs do not decode to themselves
    plain = {"pieces": [x for x in small["pieces"] if x[2] != pieces.BYTE]}
    e, rng = pieces.Encoder(plain), np.random.default_rng(5)
    assert "①" not in e.vocab
    for n in (3_000, 10, 3_000):
        text = " ".join(f"{made_up(rng, 9)} ①{i}" for i in range(n))
        ids, decoded = e.encode(text)
        assert decoded == e.decode(list(map(int, ids.split(",")))) and decoded.count(" ⁇ ") >= n
        assert held(e) <= 2 << 16
    e.encode("①x")
    assert len(e.odd) < 10
