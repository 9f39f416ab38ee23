"""Hashed features of the quality classifier read whole word shapes."""

from cadence.llm import quality


def test_long_shapes_differ():
    start = b"a1b2c3d4e5f6g7h8"
    one, two = quality.look(start + b"-z9")[1], quality.look(start + b"z-9")[1]
    assert set(one) != set(two)
