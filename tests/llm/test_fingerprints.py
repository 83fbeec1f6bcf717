"""Document fingerprints against plain versions: votes, edited texts, the ring of documents, block tables."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from llm_session import workers  # noqa: F401
from pyspark.sql import functions as F

from crease.llm import fingerprints

D = "/root/testdata/sf0.001"
LONG = "Alpha beta, gammatron! delta " * 9_000


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_votes(text, words=fingerprints.WORDS):
    """Each bit's weight, term by term."""
    import xxhash

    # str.lower and the JVM's agree on the texts of these tests
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{1,16}", (text or "").lower())
    total, ones = 0, [0] * (64 * words)
    for k, word in enumerate(w):
        first = xxhash.xxh64_intdigest(word.encode(), 42)
        found = [(first, min(max(len(word) - 3, 0), 5))]
        if k + 1 < len(w):
            found.append((xxhash.xxh64_intdigest(w[k + 1].encode(), first), 3))
        for base, weight in found:
            total += weight
            for i in range(words):
                h = base if i == 0 else _int_hash(i, base)
                for j in range(64):
                    ones[64 * i + j] += weight * (h >> j & 1)
    return [signed(sum(1 << j for j in range(64) if 2 * ones[64 * i + j] > total)) for i in range(words)]


def _int_hash(i, seed):
    """XXH64 of a long, then of an int, as Spark chains them: seeds are hashes of the column before."""
    import xxhash

    return xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), 42))


def plain(docs):
    """(doc_id, n_chars, edited sha, fingerprint, edited fingerprint, near_edited, near_next) of every row."""
    def key(d):
        name = f"{'null' if d[0] is None else d[0]}:{d[1] or ''}"
        return (d[0] is None, -(d[0] or 0), hashlib.sha256(name.encode()).hexdigest())

    order = sorted({(i, t or "") for i, t in docs}, key=key)
    follower = {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    seen = {}

    def votes(t):
        if t not in seen:
            seen[t] = plain_votes(t)
        return seen[t]

    def like(a, b):
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
        return 1.0 if not bits else max(0.0, math.cos(math.pi * bits / 256))

    def hexed(f):
        return "".join(f"{x & (1 << 64) - 1:016x}" for x in f)

    for i, t in docs:
        t = t or ""
        nxt, half = follower[i, t][1], len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        f, e = votes(t), votes(edited)
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(f), hexed(e), like(f, e), like(f, votes(nxt)))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r[:5]))


def check(got, docs):
    want = order(plain(docs))
    got = order(got)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:7]] == pytest.approx([x for r in want for x in r[5:7]], abs=1e-12)
    codes = [int(r[3], 16) for r in got]
    for r in got:
        near = sum((int(r[3], 16) ^ c).bit_count() <= 7 for c in codes)
        assert r[7] == (near if r[0] is not None and r[0] % 50 == 0 else None)


def test_registered_query(workers):
    from crease.llm.queries import llm_queries

    docs = [(r.doc_id, r.text) for r in workers.read.parquet(f"{D}/documents.parquet").collect()]
    rows = [tuple(r) for r in llm_queries()["op13_fingerprints"](workers, D).collect()]
    check(rows, docs)
    # half a text kept is nearer than another text
    assert sum(r[5] > r[6] for r in rows) >= 0.97 * len(rows)


def test_cases(workers):
    docs = [(0, None), (50, ""), (100, "Alpha beta."), (100, "Alpha beta."), (100, "Alpha gamma"), (None, "one two three"),
            (None, None), (3, LONG), (7, "日本語" * 30 + "😀x"), (8, "one"), (9, "\n\t 0"), (150, "alpha BETA")]
    df = workers.createDataFrame(docs, "doc_id long, text string") \
        .withColumns({c: F.lit(7) for c in ("key", "row", "w", "part", "f0", "n", "k", "copies", "kind")})
    check([tuple(r) for r in fingerprints.fingerprint_edits(df).collect()], docs)
    assert fingerprints.fingerprint_edits(df.where("false"), words=1).collect() == []
    (one,) = fingerprints.fingerprint_edits(df.where("doc_id = 8"), words=1).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ono").hexdigest()


def test_long_words_all_the_way(workers):
    # every word weighs the most that it can, and all vote alike: the lanes of a stretch are as full as they get
    docs = [(0, "thesedly " * 4_200), (1, "a" * 70_000), (50, "Pneumonia, gammatron " * 2_100), (2, "short")]
    df = workers.createDataFrame(docs, "doc_id long, text string")
    check([tuple(r) for r in fingerprints.fingerprint_edits(df).collect()], docs)


@pytest.mark.parametrize("radius, blocks", [(0, 1), (3, 4), (3, 5), (7, 8)])
def test_block_tables_find_all(workers, radius, blocks):
    import random

    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(20)]
    codes = {b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 9))) for b in base for _ in range(20)}
    rows = [(signed(c & (1 << 64) - 1), signed(c >> 64), rng.randint(1, 3)) for c in sorted(codes)]
    df = workers.createDataFrame(rows, "f0 long, f1 long, copies long")
    got = {(r.f0, r.f1): r.n_within for r in fingerprints.within(df, df, 2, radius, blocks).collect()}
    full = {(a, b): (a & (1 << 64) - 1) | (b & (1 << 64) - 1) << 64 for a, b, _ in rows}
    assert got == {q: sum(n for a, b, n in rows if (full[q] ^ full[a, b]).bit_count() <= radius) for q in full}
