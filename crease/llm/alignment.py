"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often in the corpus.

Both tokenizers encode space+text.  Byte offsets where a token of either ends
cut a document into groups; all A-B pairs of tokens in a group are links.

*Encoding.*  Texts are cut at single spaces between other characters.  Neither
tokenizer joins anything across such a place (A's pre-token begins with its
space; no piece of B has a space behind another character, which is checked),
so a document is the sequence of its stretches, and every distinct stretch of a
block of texts is encoded and aligned once.

*Inverted pair bitmaps.*  A chunk is a run of one task's documents, in slots.
For each linked id pair it has a compressed bitmap of slots: an array of 16-bit
slots if that is smaller, else one bit a slot.  Multiplicity planes hold bit k
of the link counts, one bit for each set bit of the bitmaps.  Blocks of texts
are OR-merged into their chunk's bitmaps (a very long text may span blocks), and
the popcounts, added over chunks, are the pairs' document counts.

*Scores.*  Only (chunk, pair, popcount) rows are shuffled: their number grows
with the corpus, as a chunk's size is fixed.  Each pair's count, and whether it
is the highest of its A id, returns to the chunks that hold the pair, where
postings and planes turn it into the documents' sums.  No pair's documents ever
meet in one task.

Defined cases: null and empty texts, and texts that a tokenizer does not give
back byte by byte (B reads U+2581 as a space), have no tokens: zeros and an empty
digest; a very long text is read in stretches, block by block; every row is a
document of its own, also a repeated one; ties for an A id's highest count all
count as highest; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import stage
from crease.llm.pretokens import PieceIds, byte_of_char, load, pre_tokens

CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
ENCODED_AT_ONCE = 1 << 14

@dataclass(frozen=True)
class Sizes:
    """Bounds on a task's memory; results do not depend on them."""

    block_chars: int = 4 << 20
    chunk_postings: int = 2_000_000
    chunk_docs: int = 1 << 16  # slots have 16 bits
    long_text: int = 1 << 20  # longer ones are cut lazily, so many stretches at a time:
    run_parts: int = 1 << 17
    large_group: int = 1 << 16  # links of a group from which distinct ids are multiplied


class Pair:
    """The two tokenizers of a task, and their entries' bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.path_a, self.pieces_a = path_a, PieceIds(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_of_char()
        vocab = load(path_a).get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, k in vocab.items():
            self.bytes_a[k] = bytes(map(alphabet.__getitem__, t))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space behind another character: texts cannot be cut at spaces")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode()
                        for k, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b)]
        # a digest is a sequence of entries: ids of A before "," or "|", ids of B before "," or ";"
        ends = [(len(self.bytes_a), ","), (len(self.bytes_a), "|"), (len(pieces), ","), (len(pieces), ";")]
        self.shown = np.array([f"{k}{end}" for n, end in ends for k in range(n)], dtype=object)
        self.shown_from = np.cumsum([0, *(n for n, _ in ends)])[:-1]

    def encode_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of A, and each stretch's number of ids; special strings are plain text."""
        blobs = [b"".join(map(self.pieces_a.__getitem__, pre_tokens(" " + p, self.path_a))) for p in parts]
        return (np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.int64),
                np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)

    def encode_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = [], []
        for k in range(0, len(parts), ENCODED_AT_ONCE):
            found = self.b.encode(parts[k:k + ENCODED_AT_ONCE], num_threads=1)
            n.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), np.int64, n[-1].sum()))
        return np.concatenate(flat), np.concatenate(n)

    def exact(self, parts: list[str], ids: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
        """Whether both sides give back space+stretch, byte by byte."""
        whole = [b" " + p.encode() for p in parts]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        out = np.ones(len(parts), dtype=bool)
        for k, entries in enumerate((self.bytes_a, self.bytes_b)):
            stop = np.concatenate([[0], np.cumsum(self.sizes[k][ids[k]])])
            ends = np.concatenate([[0], np.cumsum(n[k])])
            if np.array_equal(np.diff(stop[ends]), size) and \
                    b"".join(map(entries.__getitem__, ids[k].tolist())) == b"".join(whole):
                continue
            out &= [b"".join(map(entries.__getitem__, ids[k][i:j].tolist())) == w
                    for w, i, j in zip(whole, ends, ends[1:], strict=False)]
        return out


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def rows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: each place's run, and its number in the run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


@dataclass
class Parts:
    """What is known of a block's distinct stretches; links of stretch k: at[k] to at[k + 1] of codes and counts."""

    stats: np.ndarray  # rows: tokens of A, tokens of B, groups, links
    exact: np.ndarray
    shown: list[str]
    at: np.ndarray
    codes: np.ndarray
    counts: np.ndarray


def align(parts: list[str], pair: Pair, large_group: int) -> Parts:
    """Groups and links of every stretch."""
    ids, n = (list(x) for x in zip(pair.encode_a(parts), pair.encode_b(parts), strict=True))
    exact = pair.exact(parts, ids, n)
    flat, owner, end = [], [], []
    for side in (0, 1):
        of = np.repeat(np.arange(len(parts)), n[side])
        kept = exact[of]
        flat.append(ids[side][kept])
        owner.append(of[kept])
        end.append(np.cumsum(pair.sizes[side][flat[-1]]))
    # exact stretches follow each other in one row of bytes on both sides, so their ends agree
    common = np.intersect1d(*end, assume_unique=True)
    group = [np.searchsorted(common, e) for e in end]
    n_a, n_b = (np.bincount(g, minlength=len(common)) for g in group)
    links = n_a * n_b
    of_group = np.zeros(len(common), dtype=np.int64)
    of_group[group[0]] = owner[0]

    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    small = np.flatnonzero(links <= large_group)
    run, k = rows_of(links[small])
    g = small[run]
    code = flat[0][start_a[g] + k // n_b[g]] << 32 | flat[1][start_b[g] + k % n_b[g]]
    found = [(of_group[g], code, np.ones(len(g), dtype=np.int64))]
    for g in np.flatnonzero(links > large_group):  # distinct ids with their counts, not all pairs
        (a, more_a), (b, more_b) = (np.unique(f[s[g]:s[g] + n[g]], return_counts=True)
                                    for f, s, n in ((flat[0], start_a, n_a), (flat[1], start_b, n_b)))
        code = (a[:, None] << 32 | b[None, :]).ravel()
        found.append((np.full(len(code), of_group[g]), code, np.outer(more_a, more_b).ravel().astype(np.int64)))
    part, code, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((code, part))
    part, code, count = part[order], code[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (code[1:] != code[:-1])])) if len(part) \
        else np.zeros(0, int)
    part, code, count = part[new], code[new], np.add.reduceat(count, new) if len(part) else count

    # entries of the digests: A's ids of a group, then B's; the last of each has the other separator
    entry, place = [], []
    for side in (0, 1):
        last = np.concatenate([group[side][1:] != group[side][:-1], [True]]) if len(flat[side]) else np.zeros(0, bool)
        entry.append(pair.shown_from[2 * side + last.astype(int)] + flat[side])
        place.append(2 * group[side] + side)
    order = np.argsort(np.concatenate(place), kind="stable")
    text = pair.shown[np.concatenate(entry)[order]]
    size = np.bincount(owner[0], minlength=len(parts)) + np.bincount(owner[1], minlength=len(parts))
    stop = np.cumsum(size)
    shown = ["".join(text[i - n:i])[:-1] for i, n in zip(stop, size, strict=True)]
    stats = np.stack([np.bincount(owner[0], minlength=len(parts)), np.bincount(owner[1], minlength=len(parts)),
                      np.bincount(of_group, minlength=len(parts)), np.zeros(len(parts), dtype=np.int64)])
    np.add.at(stats[3], of_group, links)
    return Parts(stats, exact, shown, np.searchsorted(part, np.arange(len(parts) + 1)), code, count)


@dataclass
class Postings:
    """Pairs in order; pair k's slots are the next n[k] of slots, each with its number of links."""

    codes: np.ndarray
    n: np.ndarray
    slots: np.ndarray
    links: np.ndarray

    def pack(self, width: int) -> bytes:
        """Compressed bitmaps over ``width`` slots and the multiplicity planes."""
        dense = self.n * 16 > width
        pair = np.repeat(np.arange(len(self.n)), self.n)
        listed = self.slots[~dense[pair]].astype("<u2")
        row = (np.cumsum(dense) - 1)[pair[dense[pair]]]
        bits = np.zeros((int(dense.sum()), -(-width // 8)), dtype=np.uint8)
        at = self.slots[dense[pair]]
        np.bitwise_or.at(bits, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
        planes = [np.packbits(self.links >> k & 1, bitorder="little")
                  for k in range(int(self.links.max(initial=0)).bit_length())]
        sections = [self.codes.astype("<i8"), np.packbits(dense, bitorder="little"), self.n[~dense].astype("<i4"), listed,
                    bits, *planes]
        raw = b"".join(s.tobytes() for s in sections)
        head = np.array([len(self.codes), len(listed), len(self.links), width, len(planes), len(raw)], dtype="<i8")
        return head.tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def opened(blob: bytes):
    """codes, slots' counts by popcount, and a function that lists slots and links, of packed postings."""
    n_codes, n_listed, n_links, width, n_planes, size = (int(x) for x in np.frombuffer(blob[:48], dtype="<i8"))
    raw, at = np.frombuffer(pa.decompress(blob[48:], decompressed_size=size, codec="zstd"), dtype=np.uint8), 0

    def take(n: int, dtype) -> np.ndarray:
        nonlocal at
        at += n
        return raw[at - n:at].view(dtype)

    codes = take(8 * n_codes, "<i8")
    dense = np.unpackbits(take(-(-n_codes // 8), np.uint8), count=n_codes, bitorder="little").astype(bool)
    sizes = take(4 * int((~dense).sum()), "<i4")
    listed = take(2 * n_listed, "<u2")
    bits = take(int(dense.sum()) * -(-width // 8), np.uint8).reshape(int(dense.sum()), -1)
    planes = [take(-(-n_links // 8), np.uint8) for _ in range(n_planes)]
    n = np.zeros(n_codes, dtype=np.int64)
    n[~dense] = sizes
    n[dense] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def unpacked() -> tuple[np.ndarray, np.ndarray]:
        slots = np.zeros(n_links, dtype=np.int64)
        in_dense = np.repeat(dense, n)
        slots[~in_dense] = listed
        slots[in_dense] = np.nonzero(np.unpackbits(bits, axis=1, count=width, bitorder="little"))[1] if len(bits) else 0
        links = np.zeros(n_links, dtype=np.int64)
        for k, p in enumerate(planes):
            links |= np.unpackbits(p, count=n_links, bitorder="little").astype(np.int64) << k
        return slots, links

    return codes, n, unpacked


def or_merge(blocks: list[Postings], keep: np.ndarray | None = None) -> Postings:
    """One pair's bitmaps joined by OR, link counts of a slot added; without the slots that ``keep`` denies."""
    key = np.concatenate([np.repeat(b.codes, b.n) for b in blocks])
    slots, links = (np.concatenate([getattr(b, x) for b in blocks]) for x in ("slots", "links"))
    if keep is not None:
        kept = keep[slots]
        key, slots, links = key[kept], slots[kept], links[kept]
    codes, k = np.unique(key, return_inverse=True)
    both, links = total(k.astype(np.int64) << 16 | slots, links)
    return Postings(codes, np.bincount(both >> 16, minlength=len(codes)), both & 0xFFFF, links)


class Numbers(dict):
    """Numbers of distinct strings, in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Chunk:
    """Documents of one task in slots, and their postings so far."""

    def __init__(self, pair: Pair, sizes: Sizes):
        self.pair, self.sizes, self.ids, self.blocks, self.postings = pair, sizes, [], [], 0
        self.stats, self.exact, self.digests, self.begun = [], [], [], set()
        self._new_block()

    def _new_block(self):
        self.known = Numbers()
        self.pieces, self.chars = [], 0

    def add(self, doc_id, text: str):
        """A document in the next slot."""
        slot = len(self.ids)
        self.ids.append(doc_id)
        self.stats.append(np.zeros(4, dtype=np.int64))
        self.exact.append(bool(text))
        self.digests.append(hashlib.sha256())
        if not text:
            return
        if len(text) <= self.sizes.long_text:
            self._put(slot, CUT.split(text))
        else:
            run, at = [], 0
            for m in CUT.finditer(text):
                run.append(text[at:m.start()])
                at = m.end()
                if len(run) >= self.sizes.run_parts:
                    self._put(slot, run)
                    run = []
            self._put(slot, [*run, text[at:]])

    def _put(self, slot: int, parts: list[str]):
        self.pieces.append((slot, np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))))
        self.chars += sum(map(len, parts)) + len(parts)
        if self.chars >= self.sizes.block_chars:
            self.close_block()

    def close_block(self):
        if not self.pieces:
            return
        parts = align(list(self.known), self.pair, self.sizes.large_group)
        for slot, found in self.pieces:
            self.stats[slot] += parts.stats[:, found].sum(axis=1)
            self.exact[slot] &= bool(parts.exact[found].all())
            shown = ";".join(map(parts.shown.__getitem__, found))
            self.digests[slot].update(f";{shown}".encode() if slot in self.begun else shown.encode())
            self.begun = {slot}
        slots = np.repeat([s for s, _ in self.pieces], [len(x) for _, x in self.pieces]).astype(np.int64)
        found = np.concatenate([x for _, x in self.pieces])
        both, times = total(slots * len(self.known) + found, np.ones(len(found), dtype=np.int64))
        slots, found = both // len(self.known), both % len(self.known)
        run, k = rows_of((parts.at[1:] - parts.at[:-1])[found])
        at = parts.at[found][run] + k
        one = Postings(parts.codes[at], np.ones(len(at), dtype=np.int64), slots[run], parts.counts[at] * times[run])
        self.blocks.append(or_merge([one]))
        self.postings += len(self.blocks[-1].slots)
        self._new_block()

    @property
    def full(self) -> bool:
        # the open block has about a posting for every six characters
        return len(self.ids) >= self.sizes.chunk_docs or self.postings + self.chars // 6 >= self.sizes.chunk_postings

    def packed(self) -> bytes:
        keep = np.array(self.exact, dtype=bool)
        none = np.zeros(0, dtype=np.int64)
        merged = or_merge(self.blocks or [Postings(none, none, none, none)], keep)
        return merged.pack(len(self.ids))

    def rows(self, number: int) -> pa.RecordBatch:
        """One row per slot, and one with the packed postings (slot null)."""
        self.close_block()
        n = len(self.ids)
        stats = np.stack(self.stats) * np.array(self.exact, dtype=np.int64)[:, None]
        shown = [d.hexdigest() if ok else "" for d, ok in zip(self.digests, self.exact, strict=True)]
        columns = [pa.array([number] * (n + 1), pa.int64()), pa.array([*range(n), None], pa.int32()),
                   pa.array([*self.ids, None], pa.int64()),
                   *[pa.array([*stats[:, k].tolist(), None], pa.int64()) for k in range(4)],
                   pa.array([*shown, None], pa.string()), pa.array([None] * n + [self.packed()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


CHUNK_SCHEMA = "chunk long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, " \
    "groups_sha256 string, postings binary"


def chunks(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
           sizes: Sizes | None = None) -> DataFrame:
    """Every document's own columns, and every chunk's packed postings."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        chunk = Chunk(tokenizers_of(path_a, path_b), sizes or Sizes())
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                chunk.add(i.as_py(), t.as_py() or "")
                if chunk.full:
                    yield chunk.rows(task << 24 | number)
                    chunk, number = Chunk(chunk.pair, chunk.sizes), number + 1
        if chunk.ids:
            yield chunk.rows(task << 24 | number)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, CHUNK_SCHEMA)


def pair_rows(postings: DataFrame) -> DataFrame:
    """chunk, pair (A's id in the high 32 bits) and n, the popcount of its bitmap."""

    def run(batches):
        for b in batches:
            for number, blob in zip(b.column(0), b.column(1), strict=True):
                codes, n, _ = opened(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), number.as_py(), dtype=np.int64)),
                                                  pa.array(codes), pa.array(n)], ["chunk", "pair", "n"])

    return postings.select("chunk", "postings").mapInArrow(run, "chunk long, pair long, n long")


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, its document count, and whether that is the highest of its A id."""
    counts = pair_rows(postings).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # a row for each entry of A, at most
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _sums(postings: pa.Table, scores: pa.Table) -> pa.Table:
    """The slots' sums over one chunk."""
    codes, n, unpacked = opened(postings.column("postings")[0].as_py())
    pair, count, best = (scores.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    if not np.array_equal(pair[order], codes):
        raise RuntimeError("a chunk's pairs and the scores returned to it differ")
    slots, links = unpacked()
    size = int(slots.max(initial=-1)) + 1
    of_best, of_count = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    np.add.at(of_best, slots, links * np.repeat(best[order].astype(np.int64), n))
    np.add.at(of_count, slots, links * np.repeat(count[order], n))
    return pa.table({"chunk": np.full(size, postings.column("chunk")[0].as_py(), dtype=np.int64),
                     "slot": np.arange(size, dtype=np.int32), "n_best": of_best, "count_sum": of_count})


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
            sizes: Sizes | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    found, _ = stage(chunks(docs, path_a, path_b, doc_id, text, sizes), "alignment")
    postings = found.where("slot is null").select("chunk", "postings")
    told = pair_rows(postings).select("chunk", "pair").join(pair_counts(postings), "pair")
    sums = postings.groupBy("chunk").cogroup(told.groupBy("chunk")) \
        .applyInArrow(_sums, "chunk long, slot int, n_best long, count_sum long")
    own = found.where("slot is not null").drop("postings")
    zero = F.lit(0).cast("long")
    return own.join(sums, ["chunk", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
