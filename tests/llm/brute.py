"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def warc(pages):
    groups = defaultdict(list)
    for i, html in pages:
        groups[html or ""].append(i)
    out = []
    for i, html in pages:
        body = (html or "").encode()
        top = max(groups[html or ""])
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if i == top else "revisit", None if i == top else top))
    return out


def fingerprint(text, shingle=3):
    import xxhash

    w = blank_words(text)
    grams = [" ".join(w[k:k + shingle]) for k in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, max_bits=2):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in range(k):
            if (fps[k] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((root(ids[j]), root(i)))
                up[b] = a
    return {i: root(i) for i in ids}


def decontaminate(docs, items, window=10):
    patterns = defaultdict(set)
    for i, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k:k + n])].add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in patterns:
                    hit |= set(range(k, k + n))
                    found |= patterns[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit)))
    return out


def phrase_places(text, phrases):
    w = plain_words(text)
    at = [(k, label) for p, label in phrases.items() for k in range(len(w))
          if w[k:k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def licence_labels(text, ordered, phrases):
    """Labels and score by trying every rule without prefilter, and every pair of intervals."""
    canon = "".join(f" {w}" for w in ["^", *plain_words(text)])[1:] + " "
    found = [(m.start(), m.end(), r.priority, -n, r) for n, r in enumerate(ordered)
             for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", canon, re.ASCII)]
    kept = [a for a in found if not any(
        b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and
        ((b[0], -b[1], -b[2], -b[3]) < (a[0], -a[1], -a[2], -a[3])) for b in found)]
    base = {label for p, label in phrases.items() if f" {p} " in canon}
    weight = max((a[4].weight for a in kept), default=0.5 if base else 0.0)
    return ",".join(sorted(base | {a[4].label for a in kept})), weight


def nearest(ids, x, query, k=20):
    ids, x = np.asarray(ids), np.asarray(x, float)
    s = x @ x[ids == query][0]
    order = [o for o in np.lexsort((ids, -s)) if ids[o] != query][:k]
    return [int(ids[o]) for o in order]


class Katz:
    """The model of the docstring, over dictionaries."""

    def __init__(self, docs, held=2, parts=7):
        from crease.llm.katz import discounts

        self.tokens = [(i, [*blank_words(t), None]) for i, t in docs]
        self.held = [i is not None and zlib.crc32(str(i).encode()) % parts == held for i, _ in docs]
        train = [t for (_, t), h in zip(self.tokens, self.held, strict=True) if not h]
        self.uni = Counter(w for t in train for w in t)
        self.bi = Counter(p for t in train for p in zip([("begin",), *t[:-1]], t, strict=True))
        self.context = {**self.uni, ("begin",): len(train)}
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1, self.d2 = (discounts(Counter(min(c, 7) for c in x.values())) for x in (self.uni, self.bi))
        self.unknown = 1 - sum(self.kept(c, self.d1) for c in self.uni.values()) / self.n if self.n else 1.0
        self.mass, self.share = defaultdict(float), defaultdict(float)
        for (v, w), c in self.bi.items():
            self.mass[v] += self.kept(c, self.d2)
            self.share[v] += self.unigram(w)

    @staticmethod
    def kept(c, d):
        k = len(d) - 1
        return c - 0.5 if not k else d[c] * c if c <= k else c - k * (1 - d[k])

    def unigram(self, w):
        return self.kept(self.uni[w], self.d1) / self.n if w in self.uni else self.unknown

    def p(self, w, v):
        if c := self.bi.get((v, w)):
            return self.kept(c, self.d2) / self.context[v]
        if not self.context.get(v):
            return self.unigram(w)
        return (1 - self.mass[v] / self.context[v]) / (1 - self.share[v]) * self.unigram(w)

    def rows(self):
        for (i, t), h in zip(self.tokens, self.held, strict=True):
            yield (i, h, len(t), sum(w in self.uni for w in t), self.n,
                   sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in t),
                   sum(math.log10(self.p(w, v)) for v, w in zip([("begin",), *t[:-1]], t, strict=True)))


def pieces(text, tokenizer, capacity=2048):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(k, s, first if k == 0 else capacity,
             zlib.crc32(ids[s:s + (first if k == 0 else capacity)].tobytes())) for k, s in enumerate(starts)]


def check_sequences(rows, capacity=2048):
    """rows: (sequence_id, offset, length); gapless from 0 and within the capacity."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)
