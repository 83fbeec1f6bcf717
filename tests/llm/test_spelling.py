"""Spelling variants against plain versions: sorted-list scans, lists split by windows, chains of forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_session import workers  # noqa: F401
from pyspark.sql import functions as F

from crease.llm import spelling


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(counts, ratio=10):
    """word -> (form, root, n, n_near, form_n)"""
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6).flatmap(lambda m: st.tuples(st.just(m), st.sets(st.text("abé", min_size=m, max_size=m + 1)),
                                                     st.integers(1, m + 1))))
def test_scan_finds_just_the_near_words(drawn):
    m, words, stop = drawn
    words = sorted(words)
    want = [(a, b) for a, b in combinations(range(len(words)), 2)
            if one_edit(words[a], words[b]) and min(len(words[a]), len(words[b])) == m
            and spelling.shared_prefix(words[a], words[b]) < stop]
    assert sorted(spelling.near_in_list(words, m, stop)) == want


def test_long_lists_are_split_without_loss(workers):
    letters = "aeio"
    words = [a + b + c + d + tail for a in letters for b in letters for c in letters for d in letters
             for tail in ("", "x", "xé")][::2]
    counts = {w: 1 + zlib.crc32(w.encode()) % 900 for w in words} | {"a": 5, "ab": 50, "abc": 500, "ß": 1}
    df = workers.createDataFrame(list(counts.items()), "word string, n long")
    for list_words in (2, 2000):
        got = {r.word: tuple(r)[1:] for r in spelling.group_words(df, list_words=list_words).collect()}
        assert got == plain(counts)
    assert got["a"][:2] == ("ab", "abc")


def test_cases(workers):
    long = "Wonderful wonderfully " * 20_000
    docs = [(1, None), (2, ""), (3, "Wonderful, WONDERFUL wonderfu"), (3, "Wonderful, WONDERFUL wonderfu"), (None, long),
            (4, "ÉCLAIRAGE éclairage Éclairage ÉCLAIRAGE"), (5, "naïveté2naïveté short wonderfulĀwonderful"), (6, "\n")]
    df = workers.createDataFrame(docs, "doc_id long, text string") \
        .withColumns({c: F.lit(7) for c in ("word", "n", "key", "run", "h", "id", "root")})
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r.word: tuple(r)[1:] for r in spelling.variants(df).collect()}
    assert got == plain(counts)
    assert spelling.variants(df.where("false")).collect() == []
