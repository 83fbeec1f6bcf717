"""Katz backoff bigram scores with Good-Turing discounts.

Model.  Tokens are a text's words (A-Z lower-cased, cut at ASCII white space)
and one end token; a begin symbol is the first token's context.  With c the
training counts, d the discount of a count, P1 the discounted unigram
distribution and N the training tokens:

    P(w | v) = d(c(v,w)) c(v,w) / c(v)    if c(v,w) > 0
             = alpha(v) P1(w)             if c(v,w) = 0 and c(v) > 0
             = P1(w)                      if c(v) = 0

    alpha(v) = (1 - sum of seen P(. | v)) / (1 - sum over the same words of P1)

P1(w) = d1(c) c / N for words of the training texts; the mass that is left is
the probability of a word not in them.  So each context's distribution sums to
one over the training words and one unknown word.

Discounts.  Counts 1..k (k <= 5) get Good-Turing's ratio, normalised so that
counts above k would need no discount: d_r = (r*/r - A) / (1 - A) with
r* = (r+1) n_{r+1} / n_r and A = (k+1) n_{k+1} / n_1.  k is lowered until all
d_r lie strictly between 0 and 1; if none does, d_r = 1 - 1/(2r).  Counts above
k lose the same absolute mass as k does (d_r = 1 - k (1 - d_k) / r), so a
context seen only with frequent words still leaves some mass for others.

Data flow.  Texts are read once, into chunk rows of about ``chunk_tokens``
tokens (packed arrays, staged).  Chunks ask for what they need from tables
that are partitioned by key: the word table gives each distinct word its
training count and a number; the bigram table counts distinct pairs of
numbers; the context table adds up each context's discounted mass.  A request
is one packed row per (chunk, bucket) of distinct keys with their counts in
the chunk, so a frequent word or pair is pre-aggregated before every shuffle,
and a frequent context's pairs are spread over all buckets.  Every pair is
owned by the first chunk that trains it, which counts it into its context.
Nothing corpus-wide reaches the driver but totals and counts of counts.
Numbers travel as small integers: a chunk's words in the order of their
numbers, so that differences are sent, and a context's masses as how many
counts of each size they come from.  Files that no later step reads are
deleted once the scores but for alphas are written.

Defined cases: null text is empty, and scored as its end token; null doc_ids
train (their remainder is unknown, so they are not held out) and are scored;
repeated rows count as often as given; without any training text every token
is unknown, with probability 1; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import discard, held_remainder, stage

END = b" "  # no word has a space in it
LIMIT = 1 << 32
BEGIN = LIMIT - 1  # number of the begin symbol
#: what tasks exchange: a chunk, a bucket, and packed arrays
PART = "chunk long, bucket int, kind string, a binary, b binary, c binary, d binary"
NAMES = [x.split()[0] for x in PART.split(", ")]
#: files of packed rows: compressed already, never equal, and so large that pages and row groups are measured at every row
FILES = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1",
         "parquet.block.size.row.check.min": "1"}


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame([r + (None,) * (len(NAMES) - len(r)) for r in rows], columns=NAMES)


def _pack(x, kind) -> bytes:
    """An array as compressed bytes, all lowest bytes first (small numbers leave planes of zeros)."""
    x = np.ascontiguousarray(x, dtype=kind)
    return zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _unpack(x: bytes, kind):
    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(keys) -> bytes:
    keys = np.asarray(keys, np.uint64)
    return _pack(np.diff(keys, prepend=np.uint64(0)), "<u8")


def _unpack_sorted(x: bytes):
    return np.cumsum(_unpack(x, "<u8"), dtype=np.uint64)


def _mix(x):
    """Spread uint64 keys over 64 bits (an odd multiplier and a shift)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


# ---------------------------------------------------------------- discounts

def discounts(counts_of_counts: dict[int, int], k: int = 5) -> list[float]:
    """d[r] for r = 0..k' (d[0] unused); k' <= k is what the counts of counts allow."""
    n = counts_of_counts
    while k > 0 and n.get(1):
        a = (k + 1) * n.get(k + 1, 0) / n[1]
        if a < 1 and all(n.get(r) for r in range(1, k + 1)):
            d = [(((r + 1) * n.get(r + 1, 0) / n[r]) / r - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return [1.0, *d]
        k -= 1
    return [1.0]


def discounted(counts, d: list[float]):
    """d(c) * c for an array of positive counts."""
    c = np.asarray(counts, np.float64)
    k = len(d) - 1
    if not k:
        return c - 0.5
    table = np.array(d)
    low = c <= k
    return np.where(low, table[np.where(low, c, 0).astype(np.int64)] * c, c - k * (1 - d[k]))


def _tally(place, counts, size: int, d: list[float]):
    """For each of ``size`` places: how many of its positive counts are 1..k, how many are larger, and the sum of these."""
    k = len(d) - 1
    many = np.bincount(place * (k + 1) + np.minimum(counts, k + 1) - 1, minlength=size * (k + 1))
    large = counts > k
    return many.reshape(size, k + 1).T, np.bincount(place[large], counts[large], size).astype(np.int64)


def _tallied(many, rest, d: list[float]):
    """Sum of :func:`discounted` over each place's counts."""
    k = len(d) - 1
    lost = k * (1 - d[k]) if k else 0.5
    return (np.array(d[1:]) * np.arange(1, k + 1)) @ many[:k] + rest - many[k] * lost


# ---------------------------------------------------------------- chunks

CHUNK = ("chunk long, tokens binary, docs binary, ids binary, words binary, sizes binary, counts binary, "
         "n_tokens long, n_train long")


def _chunks(docs: DataFrame, doc_id: str, text: str, parts: int, held: int, chunk_tokens: int) -> DataFrame:
    """Packed chunk rows: documents, their tokens as local numbers, the local words and their training counts."""
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        local, tokens, ids, flags, lengths, n = None, [], [], [], [], 0

        def flush():
            words, every, rest = list(local), np.concatenate(tokens), np.array(flags)
            counts = np.bincount(every[np.repeat(~rest, lengths)], minlength=len(words))
            by_count = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[by_count] = np.arange(len(words))
            row = [chunk, _pack(rank[every], "<i4"), _pack(np.r_[rest, lengths], "<i4"),
                   _pack([x or 0 for x in ids] + [x is not None for x in ids], "<i8"),
                   zlib.compress(b"".join([words[k] for k in by_count]), 1),
                   _pack([len(words[k]) for k in by_count], "<i4"), _pack(counts[by_count], "<i4"),
                   n, int((~rest).sum())]
            kinds = [pa.binary() if isinstance(x, bytes) else pa.int64() for x in row]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for b in batches:
            for key, rest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if local is None:
                    local, tokens, ids, flags, lengths, n = defaultdict(itertools.count().__next__), [], [], [], [], 0
                words = (t.as_py() or "").encode().lower().split()
                words.append(END)
                tokens.append(np.fromiter(map(local.__getitem__, words), "<i4", len(words)))
                ids.append(key)
                flags.append(rest == held)
                lengths.append(len(words))
                n += len(words)
                if n >= chunk_tokens:
                    yield flush()
                    chunk, local = chunk + 1, None
        if local is not None:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_remainder(doc_id, parts).alias("rest"),
                       F.col(text).cast("string").alias("text")).mapInArrow(run, CHUNK)


def _cut(words: bytes, sizes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [words[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _buckets(chunk, where, buckets: int, *arrays):
    """A row for each bucket that has some of the chunk's keys."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            at = order[cuts[k]:cuts[k + 1]]
            yield (chunk, k, "ask", *(f(at) for f in arrays))


# ---------------------------------------------------------------- words

def _ask_words(buckets: int):
    from xxhash import xxh64_intdigest

    def run(frames):
        for f in frames:
            for row in f.itertuples(index=False):
                sizes, counts = _unpack(row.sizes, "<i4"), _unpack(row.counts, "<i4")
                words = _cut(zlib.decompress(row.words), sizes)
                where = np.fromiter((xxh64_intdigest(w, 42) % buckets for w in words), np.int64, len(words))
                yield _frame(_buckets(row.chunk, where, buckets,
                                      lambda at, w=words: zlib.compress(b"".join([w[i] for i in at]), 1),
                                      lambda at, s=sizes: _pack(s[at], "<i4"), lambda at, c=counts: _pack(c[at], "<i4"),
                                      lambda at: _pack(at, "<i4")))

    return run


def _count_words(buckets: int):
    def run(key, f):
        bucket = key[0]
        total: dict[bytes, int] = {}
        asked = []
        for row in f.itertuples(index=False):
            words = _cut(zlib.decompress(row.a), _unpack(row.b, "<i4"))
            for w, c in zip(words, _unpack(row.c, "<i4").tolist(), strict=True):
                total[w] = total.get(w, 0) + c
            asked.append((row.chunk, words, row.d))
        # numbers by falling count: frequent words get small ones
        ranked = sorted(total, key=lambda w: (-total[w], w))
        if len(ranked) * buckets >= LIMIT:
            raise OverflowError("more distinct words than 32-bit numbers")
        rank = {w: k for k, w in enumerate(ranked)}
        counts = np.fromiter((total[w] for w in ranked), np.int64, len(ranked))
        out = [(-1, bucket, "table", zlib.compress(b"".join(ranked), 1), _pack([len(w) for w in ranked], "<i4"),
                _pack(counts, "<i8"))]
        for chunk, words, at in asked:
            ranks = np.fromiter((rank[w] for w in words), np.int64, len(words))
            order = np.argsort(ranks)
            ranks = ranks[order]
            out.append((chunk, bucket, "word", _pack(_unpack(at, "<i4")[order], "<i4"),
                        _pack(np.diff(ranks, prepend=0), "<u4"), _pack(-np.diff(counts[ranks], prepend=0), "<i8")))
        return _frame(out)

    return run


# ---------------------------------------------------------------- bigrams

def _by_kind(rows: pd.DataFrame) -> dict[str, list]:
    out = defaultdict(list)
    for row in rows.itertuples(index=False):
        out[row.kind].append(row)
    return out


def _numbers(rows, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Global number (its rank in its bucket times the buckets, and the bucket) and training count of each local word."""
    got = [(r.bucket, _unpack(r.a, "<i4"), _unpack(r.b, "<u4"), _unpack(r.c, "<i8")) for r in rows]
    n = sum(len(at) for _, at, _, _ in got)
    number, count = np.zeros(n, "<u4"), np.zeros(n, "<i8")
    for bucket, at, ranks, falls in got:
        number[at], count[at] = np.cumsum(ranks, dtype=np.int64) * buckets + bucket, -np.cumsum(falls)
    return number, count


class _Chunk:
    """A chunk's positions as distinct pairs of context and token."""

    def __init__(self, parts, buckets: int = 1):
        row = parts["chunk"][0]
        self.tokens = _unpack(row.a, "<i4").astype(np.int64)
        self.held, self.lengths = _unpack(row.b, "<i4").reshape(2, -1).astype(np.int64)
        self.ids = row.c
        self.numbers, self.counts = _numbers(parts["word"], buckets)
        n = self.n = len(self.numbers)  # local number of the begin symbol
        self.starts = np.cumsum(self.lengths) - self.lengths
        context = np.r_[n, self.tokens[:-1]]
        context[self.starts] = n
        pairs, self.place = np.unique(context * (n + 1) + self.tokens, return_inverse=True)
        self.context, self.token = pairs // (n + 1), pairs % (n + 1)
        self.globals = np.r_[self.numbers.astype(np.uint64), np.uint64(BEGIN)]
        self.keys = (self.globals[self.context] << np.uint64(32)) | self.globals[self.token]


def _ask_pairs(buckets: int):
    def run(key, f):
        chunk = _Chunk(_by_kind(f), buckets)
        train = np.repeat(chunk.held == 0, chunk.lengths)
        trained = np.bincount(chunk.place[train], minlength=len(chunk.keys))
        order = np.argsort(chunk.keys)
        keys, trained = chunk.keys[order], trained[order]
        where = (_mix(keys) % np.uint64(buckets)).astype(np.int64)
        return _frame(_buckets(key[0], where, buckets, lambda at: _pack_sorted(keys[at]),
                               lambda at: _pack(trained[at], "<i4")))

    return run


def _count_pairs(key, f):
    """Training count of every asked pair, and 1 where the asking chunk owns it; the bucket's count table."""
    f = f.sort_values("chunk")
    keys = [_unpack_sorted(x) for x in f.a]
    trained = np.concatenate([_unpack(x, "<i4") for x in f.b])
    cuts = np.cumsum([0, *map(len, keys)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, trained, len(distinct)).astype(np.int64)
    at = np.flatnonzero(trained)[::-1]
    first = np.full(len(distinct), -1)
    first[place[at]] = at  # the last to write is the first asker that trains the pair
    seen = total > 0
    owns = np.zeros(len(place), bool)
    owns[first[seen]] = True
    out = [(-1, key[0], "table", _pack_sorted(distinct[seen]), _pack(total[seen], "<i8"))]
    for k, chunk in enumerate(f.chunk):
        part = slice(cuts[k], cuts[k + 1])
        out.append((chunk, key[0], "pair", _pack(total[place[part]], "<i8"), _pack(owns[part], np.uint8)))
    return _frame(out)


def _answers(rows, keys, buckets: int):
    """Counts and ownership in the order of ``keys`` (global pair keys), from the buckets' answers."""
    order = np.argsort(keys)
    where = (_mix(keys[order]) % np.uint64(buckets)).astype(np.int64)
    order = order[np.argsort(where, kind="stable")]
    cuts = np.searchsorted(np.sort(where), np.arange(buckets + 1))
    count, owns = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for r in rows:
        at = order[cuts[r.bucket]:cuts[r.bucket + 1]]
        count[at], owns[at] = _unpack(r.a, "<i8"), _unpack(r.b, np.uint8).astype(bool)
    return count, owns


# ---------------------------------------------------------------- contexts

class Model:
    """Totals and discounts; small enough for the driver at any corpus size.

    ``words`` and ``pairs`` are counts of counts, 7 standing for 7 and more.
    """

    def __init__(self, tokens: int, words: dict[int, int], pairs: dict[int, int], documents: int):
        self.tokens, self.words, self.documents = tokens, sum(words.values()), documents
        self.d1, self.d2 = discounts(words), discounts(pairs)
        lost = sum(n * float(r - discounted([r], self.d1)[0]) for r, n in words.items())
        self.unknown = lost / tokens if tokens else 1.0

    def unigram(self, counts):
        """P1 of words with these training counts."""
        c = np.asarray(counts, np.float64)
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, discounted(np.maximum(c, 1), self.d1) / self.tokens, self.unknown)


def _ask_contexts(buckets: int, model: Model):
    """Scores but for alphas; the mass that the chunk's own pairs give their contexts; contexts of unseen pairs."""

    def run(key, f):
        parts = _by_kind(f)
        chunk = _Chunk(parts, buckets)
        count, owns = _answers(parts["pair"], chunk.keys, buckets)
        n, docs = chunk.n, len(chunk.lengths)
        p1 = model.unigram(chunk.counts)
        of_context = np.r_[chunk.counts, model.documents].astype(np.float64)
        known_context = of_context[chunk.context] > 0
        seen = discounted(np.maximum(count, 1), model.d2) / np.maximum(of_context[chunk.context], 1)
        logs = np.log10(np.where(count > 0, seen, p1[chunk.token]))
        base = np.log10((chunk.counts + 1) / (model.tokens + 1 * (model.words + 1)))

        pairs, large = _tally(chunk.context[owns], count[owns], n + 1, model.d2)
        words, frequent = _tally(chunk.context[owns], chunk.counts[chunk.token[owns]], n + 1, model.d1)
        backs_off = (count == 0) & known_context
        asks, gives = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        asks[chunk.context[backs_off]] = True
        gives[chunk.context[owns]] = True
        open_ = np.flatnonzero(backs_off[chunk.place])
        slot = np.cumsum(asks) - 1  # the chunk's asked contexts, numbered
        doc = np.repeat(np.arange(docs), chunk.lengths)[open_]
        table = np.stack([chunk.held, chunk.lengths,
                          np.add.reduceat((chunk.counts > 0)[chunk.tokens].astype(np.float64), chunk.starts),
                          np.add.reduceat(base[chunk.tokens], chunk.starts),
                          np.add.reduceat(logs[chunk.place], chunk.starts)])
        rows = [(key[0], -1, "partial", chunk.ids, _pack(table, "<f8"), _pack(doc, "<i4"),
                 _pack(slot[chunk.context[chunk.place[open_]]], "<i4"))]

        at = np.flatnonzero(asks | gives)
        at = at[np.argsort(chunk.globals[at])]
        names = chunk.globals[at]
        many = np.concatenate([pairs, words])[:, at]
        # whoever asks for a context's alpha relies on its owners for its count
        sums = np.stack([large[at], frequent[at], np.where(gives[at], of_context[at].astype(np.int64), 0)])
        slots = np.where(asks[at], slot[at], -1)
        where = (_mix(names) % np.uint64(buckets)).astype(np.int64)
        rows += _buckets(key[0], where, buckets, lambda x: _pack_sorted(names[x]), lambda x: _pack(many[:, x], "<i4"),
                         lambda x: _pack(slots[x], "<i4"), lambda x: _pack(sums[:, x], "<i8"))
        return _frame(rows)

    return run


def _sum_contexts(model: Model):
    """Alpha of every context in the bucket, and of those that a chunk asked for, by its slots."""

    def run(key, f):
        f = f.sort_values("chunk")
        names = [_unpack_sorted(x) for x in f.a]
        cuts = np.cumsum([0, *map(len, names)])
        distinct, place = np.unique(np.concatenate(names), return_inverse=True)
        kept, share, total = np.zeros((3, len(distinct)))
        for k, row in enumerate(f.itertuples(index=False)):
            at = place[cuts[k]:cuts[k + 1]]  # a chunk has each context once
            many, sums = _unpack(row.b, "<i4").reshape(-1, len(at)), _unpack(row.d, "<i8").reshape(3, -1)
            kept[at] += _tallied(many[:len(model.d2)], sums[0], model.d2)
            share[at] += _tallied(many[len(model.d2):], sums[1], model.d1) / model.tokens
            total[at] = np.maximum(total[at], sums[2])
        alpha = (1 - kept / total) / (1 - share)
        out = [(-1, key[0], "table", _pack_sorted(distinct), _pack(alpha, "<f8"))]
        for k, row in enumerate(f.itertuples(index=False)):
            slots = _unpack(row.c, "<i4")
            if (slots >= 0).any():
                out.append((row.chunk, key[0], "alpha", _pack(slots[slots >= 0], "<i4"),
                            _pack(alpha[place[cuts[k]:cuts[k + 1]][slots >= 0]], "<f8")))
        return _frame(out)

    return run


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _finish(model: Model):
    """Add the alphas' logs to the documents whose tokens backed off."""

    def run(key, f):
        parts = _by_kind(f)
        row = parts["partial"][0]
        held, lengths, known, base, logs = _unpack(row.b, "<f8").reshape(5, -1)
        doc, slot = _unpack(row.c, "<i4"), _unpack(row.d, "<i4")
        alpha = np.ones(1 + max(slot, default=-1))
        for r in parts["alpha"]:
            alpha[_unpack(r.a, "<i4")] = _unpack(r.b, "<f8")
        ids, ok = _unpack(row.a, "<i8").reshape(2, -1)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids, ok == 0), "held_out": held > 0, "n_tokens": lengths.astype(np.int64), "n_known": known.astype(np.int64),
            "train_tokens": np.int64(model.tokens), "base_score": base,
            "score": logs + np.bincount(doc, np.log10(alpha[slot]), len(lengths))})

    return run


def _count_stats(frames):
    """Counts of counts 1..6 and of larger ones (as 7), with their tokens."""
    for f in frames:
        for x in f.c:
            c = _unpack(x, "<i8")
            c = c[c > 0]
            of = np.minimum(c, 7)
            yield pd.DataFrame({"r": np.arange(1, 8), "n": np.bincount(of, minlength=8)[1:].astype(np.int64),
                                "tokens": np.bincount(of, c, 8)[1:].astype(np.int64)})


def _totals(tables: DataFrame, column: str) -> tuple[dict[int, int], int]:
    stats = tables.where("kind = 'table'").select(F.col(column).alias("c")) \
        .mapInPandas(_count_stats, "r long, n long, tokens long").groupBy("r").agg(F.sum("n"), F.sum("tokens"))
    rows = stats.collect()  # seven rows at most
    return {r: n for r, n, _ in rows if n}, sum(t for _, _, t in rows)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, held: int = 2,
          chunk_tokens: int = 1 << 19, bucket_pairs: int = 1 << 21) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    chunks, chunk_files = stage(_chunks(docs, doc_id, text, parts, held, chunk_tokens), "katz-chunks", **FILES)
    sums = chunks.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    if sums[0] is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    buckets = max(8, min(sums[0] // bucket_pairs, 1 << 16))

    asked = chunks.select("chunk", "words", "sizes", "counts").mapInPandas(_ask_words(buckets), PART)
    word_rows, word_files = stage(asked.groupBy("bucket").applyInPandas(_count_words(buckets), PART), "katz-words", **FILES)
    words, tokens = _totals(word_rows, "c")

    own = chunks.selectExpr("chunk", "-1 as bucket", "'chunk' as kind", "tokens as a", "docs as b", "ids as c",
                            "cast(null as binary) as d").unionByName(word_rows.where("kind = 'word'"))
    asked = own.groupBy("chunk").applyInPandas(_ask_pairs(buckets), PART)
    pair_rows, pair_files = stage(asked.groupBy("bucket").applyInPandas(_count_pairs, PART), "katz-pairs", **FILES)
    pairs, _ = _totals(pair_rows, "b")
    model = Model(tokens, words, pairs, sums[1])

    told = own.unionByName(pair_rows.where("kind = 'pair'"))
    part_rows, _ = stage(told.groupBy("chunk").applyInPandas(_ask_contexts(buckets, model), PART), "katz-partial", **FILES)
    discard(docs.sparkSession, chunk_files, word_files, pair_files)
    asked = part_rows.where("kind = 'ask'").groupBy("bucket").applyInPandas(_sum_contexts(model), PART)
    alphas, _ = stage(asked, "katz-contexts", **FILES)
    last = part_rows.where("kind = 'partial'").unionByName(alphas.where("kind = 'alpha'"))
    return last.groupBy("chunk").applyInPandas(_finish(model), RESULT)
