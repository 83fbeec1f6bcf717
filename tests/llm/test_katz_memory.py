"""Memory that one task of Katz needs for a chunk of the size that production uses."""

import inspect
import tracemalloc

import numpy as np

from crease.llm import katz


def test_a_chunk_of_default_size_is_unpacked_in_little_memory():
    n, words = inspect.signature(katz.score).parameters["chunk_tokens"].default, 100_000
    tokens = np.random.default_rng(1).integers(0, words, n)
    chunk = (0, -1, "chunk", katz._pack(tokens, "<i4"), katz._pack([0, n], "<i4"), katz._pack([1, 1], "<i8"))
    told = (0, 0, "word", katz._pack(np.arange(words), "<i4"), katz._pack(np.arange(words), "<u4"),
            katz._pack(np.ones(words), "<i8"))
    parts = katz._by_kind(katz._frame([chunk, told]))
    del tokens
    tracemalloc.start()
    try:
        got = katz._Chunk(parts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got.place) == n and got.keys[got.place[-1]] & np.uint64(0xFFFFFFFF) == got.globals[got.tokens[-1]]
    assert peak < 100 << 20
