"""Corpus-wide counts of Katz beyond 32 bits."""

import numpy as np

from crease.llm import katz


def test_pair_seen_more_often_than_32_bits_hold():
    keys, often = np.array([5, 9], np.uint64), (1 << 31) - 1
    asked = katz._frame([(chunk, 0, "ask", katz._pack_sorted(keys), katz._pack([often, 1], "<i4")) for chunk in range(3)])
    told = katz._by_kind(katz._count_pairs((0,), asked))
    for row in told["pair"]:
        count, owns = katz._answers([row], keys, 1)
        assert count.tolist() == [3 * often, 3] and owns.tolist() == [row.chunk == 0] * 2
    assert katz._unpack(told["table"][0].b, "<i8").tolist() == [3 * often, 3]
