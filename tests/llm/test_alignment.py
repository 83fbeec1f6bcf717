"""Cross-tokenizer alignment against a plain version over whole texts; packed bitmaps and planes."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_session import workers  # noqa: F401
from pyspark.sql import functions as F

from crease.llm import alignment
from crease.llm.pretokens import byte_of_char
from crease.llm.queries import tokenizer_path

D = "/root/testdata/sf0.001"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
CASES = [(1, None), (2, ""), (3, "Alpha beta beta, gamma"), (3, "Alpha beta beta, gamma"), (None, "one two"),
         (4, "a  b\n c \t d　e  "), (5, "日本語 x 😀 a<|endoftext|>b naïve <s> <0x41>"), (6, "\n \t"), (7, "low▁line here"),
         (8, " leading"), (9, "  two"), (10, "it's we'll 'tis 12 345"), (11, "x\x1c y  z \x85w"), (12, " "),
         (13, "Lorem ipsum dolor 日本 " * 4000), (14, "b64" * 3000), (15, "é " * 10)]


def plain_groups(text):
    """Groups as pairs of id lists, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = byte_of_char()
    if not text:
        return []
    a, b = tok.encode(" " + text, add_special_tokens=False), sp.encode(text)
    of_a = [bytes(chars[c] for c in t) for t in a.tokens]
    of_b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else
            sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return []
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (of_a, of_b)]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append((a.ids[i:p], b[j:q]))
        i, j = p, q
    return groups


def plain(docs):
    all_groups = [plain_groups(t) for _, t in docs]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in all_groups]
    count = Counter(p for c in links for p in c)
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for (i, _), g, c in zip(docs, all_groups, links, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), c.total(),
               sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()),
               hashlib.sha256(shown.encode()).hexdigest() if g else "")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_registered_query(workers):
    from crease.llm.queries import llm_queries

    docs = [(r.doc_id, r.text) for r in workers.read.parquet(f"{D}/documents.parquet").collect()]
    assert order(map(tuple, llm_queries()["op11_alignment"](workers, D).collect())) == order(plain(docs))


def test_cases(workers):
    df = workers.createDataFrame(CASES, "doc_id long, text string").coalesce(2) \
        .withColumns({c: F.lit(7) for c in ("chunk", "slot", "pair", "n", "count", "best", "n_a", "postings")})
    # long texts in pieces, blocks and chunks of few documents, groups of distinct ids
    small = alignment.Sizes(100, 10_000, 3, 50, 7, 4)
    assert order(map(tuple, alignment.aligned(df, A, B, sizes=small).collect())) == order(plain(CASES))
    assert alignment.aligned(df.where("false"), A, B).collect() == []


@pytest.mark.parametrize("width", [1, 9, 3000])
def test_packed_bitmaps_round_trip_and_merge(width):
    rng = np.random.default_rng(width)
    held = {int(c): {int(s): int(rng.integers(1, 40)) for s in rng.choice(width, rng.integers(1, width + 1), replace=False)}
            for c in rng.choice(1 << 40, 30, replace=False)}

    def postings(x):
        codes = sorted(x)
        return alignment.Postings(np.array(codes, dtype=np.int64), np.array([len(x[c]) for c in codes], dtype=np.int64),
                                  np.array([s for c in codes for s in sorted(x[c])], dtype=np.int64),
                                  np.array([x[c][s] for c in codes for s in sorted(x[c])], dtype=np.int64))

    one = postings(held)
    codes, n, unpacked = alignment.opened(one.pack(width))
    slots, links = unpacked()
    for got, want in ((codes, one.codes), (n, one.n), (slots, one.slots), (links, one.links)):
        assert np.array_equal(got, want)
    both = alignment.or_merge([one, one, postings({5: {0: 2}})])
    assert both.codes.tolist() == sorted({*held, 5}) and both.n.sum() == one.n.sum() + 1
    assert both.links.sum() == 2 * one.links.sum() + 2
    keep = np.arange(width) % 2 == 0
    assert set(alignment.or_merge([one], keep).slots.tolist()) <= set(range(0, width, 2))
