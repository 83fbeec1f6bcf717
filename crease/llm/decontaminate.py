"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every ``window`` consecutive words of a benchmark item are a pattern; an item
of fewer words (but not none) is one pattern.  Patterns are grouped by length,
and each length has its own Wu-Manber tables over blocks of two words (one for
one-word patterns): the shift table says how far a search position may move on
when it stands at a block, the suffix bucket of a block at which it may not
move lists the patterns that end there, and these are compared word by word.
A block in no pattern moves the search by the whole pattern length less one.

A document's words inside any occurrence are hit.  Documents are searched where
they are read: no shuffle.  The patterns are broadcast in groups of items of at
most ``group_bytes`` of text (one group for any usual benchmark); each further
group is one more pass in the same stage, which adds to the hits so far.

Defined cases: null text has no words; an item without words has no patterns; a
null item_id marks hits but names no item; an item_id that repeats counts once;
repeated document rows are returned as often as given; an empty benchmark hits
nothing; only id and text columns are read.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# every ASCII byte but digits and letters separates words; bytes over 0x7F belong to words
SEPARATORS = bytes(x if x > 0x7F or chr(x).isalnum() else 0x20 for x in range(256))
SPANS = "spans array<struct<start:int,stop:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or "").encode().lower().translate(SEPARATORS).split()


class WuManber:
    """Search tables for word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.default = self.length - self.block + 1
        shift: dict = {}
        suffix = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block:end]
                shift[key] = min(shift.get(key, self.default), self.length - end)
            suffix[pattern[-self.block:]].append((list(pattern), items))
        self.shift, self.suffix = shift, dict(suffix)

    def search(self, words: list[bytes]):
        """(start, items) of every occurrence, by start."""
        length, default, shift = self.length, self.default, self.shift
        if self.block == 1:
            for at, word in enumerate(words):
                if (word,) in shift:
                    for _, items in self.suffix[(word,)]:
                        yield at, items
            return
        end, n, move = length - 1, len(words), shift.get
        while end < n:
            step = move((words[end - 1], words[end]), default)
            if step:
                end += step
                continue
            for pattern, items in self.suffix[(words[end - 1], words[end])]:
                if words[end - length + 1:end + 1] == pattern:
                    yield end - length + 1, items
            end += 1


def matchers(items: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """Search tables of benchmark items, one for each pattern length."""
    by_length: dict = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for start in range(len(words) - n + 1 if n else 0):
            found = by_length[n][tuple(words[start:start + n])]
            if item_id is not None:
                found.add(item_id)
    return [WuManber({p: frozenset(i) for p, i in patterns.items()}) for _, patterns in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same places."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
              item_id: str = "item_id", item_text: str = "text", group_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with its columns kept as struct ``doc``, and n_words, spans (hit words) and items (ids) beside it."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                      F.col(text).cast("string").alias("text"))
    out = out.selectExpr("doc", "text", "0 as n_words", "cast(array() as array<struct<start:int,stop:int>>) as spans",
                         "cast(array() as array<string>) as items")
    for k in range(groups):
        part = bench if groups == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == k)
        tables = spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])
        out = out.mapInArrow(_searcher(tables, window), out.schema)
    return out.drop("text")


def _searcher(items, window: int):
    def run(batches):
        tables = matchers(items.value, window)
        for b in batches:
            texts, old_spans, old_items = (b.column(n).to_pylist() for n in ("text", "spans", "items"))
            counts, spans, found = [], [], []
            for t, was, had in zip(texts, old_spans, old_items, strict=True):
                words, ids = words_of(t), set(had)
                at = [(x["start"], x["stop"]) for x in was]
                for table in tables:
                    for start, named in table.search(words):
                        at.append((start, start + table.length))
                        ids |= named
                counts.append(len(words))
                spans.append([{"start": x, "stop": y} for x, y in merged(at)])
                found.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([
                b.column("doc"), b.column("text"), pa.array(counts, pa.int32()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                pa.array(found, pa.list_(pa.string()))], ["doc", "text", "n_words", "spans", "items"])

    return run


def digest(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, word and hit counts, items and verdict of every row of :func:`find_hits`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return hits.select(F.col(f"doc.{doc_id}").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"),
                       n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    return find_hits(docs, benchmark, **options).where(F.size("spans") == 0).select("doc.*")
