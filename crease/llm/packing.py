"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A document's ids (and a closing id 0) make one piece if they fit a sequence;
longer documents are cut into full sequences, the first piece taking the rest.
Full pieces are sequences of their own.  All other pieces are dealt into blocks
of bounded size, in turn along their sorted lengths.  A block is a bin-packing problem that several
islands (separate rows, so separate tasks) evolve: an individual is a grouping
of pieces into bins; crossover injects whole well-filled bins of one parent
into the other, removes the bins that then hold duplicates, and best-fits the
displaced pieces; after each epoch an island's elite migrates to the next one
in the ring.  An island rests once its elite needs no more bins than the
block's tokens do.  The emptiest bins of each block are opened again and their
pieces pooled into fewer blocks, until one block is left.  Where that would not
leave fewer pieces (bins of very many small ones), the open bins are pooled as
wholes; a round ends the search if even these are not half as many.  So pieces
or bins fall by a constant share in every round.

Defined cases: null text is empty and makes a piece of one id; a very long text
is cut into full pieces and one rest; repeated rows are packed as often as
given; null doc_ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import discard, stage
from crease.llm.pretokens import PieceIds, encode_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
LESS = 0.75  # share of the pieces that a round may leave for the next one
PLACED = "piece_key long, length long, sequence_id long, offset long, open boolean"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, doc_id: str = "doc_id", text: str = "text",
              end_id: int = 0) -> DataFrame:
    """A row per piece of every document, with the checksum of its ids; no shuffle."""
    end = struct.pack("<I", end_id)

    def run(batches):
        known = PieceIds(tokenizer_path)
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode_bytes(t.as_py() or "", known) + end
                rows += [(key, k, s, n, zlib.crc32(memoryview(ids)[4 * s:4 * (s + n)]))
                         for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, PIECES)


class Grouping:
    """An individual: pieces grouped into bins, with the bins' free room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins that had this much room when listed
        self.some = 0  # bit r: a bin may have room r
        self.new = 0

    def _list(self, k: int) -> None:
        r = self.room[k]
        self.at[r].append(k)
        self.some |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        k = self.new = self.new + 1
        self.bins[k] = list(items)
        self.room[k] = self.capacity - sum(self.sizes[i] for i in items)
        self._list(k)

    def drop_bin(self, k: int) -> list[int]:
        del self.room[k]
        return self.bins.pop(k)

    def best_fit(self, items: list[int]) -> None:
        """Put each item, largest first, into the bin with the least room that takes it."""
        for i in sorted(items, key=lambda i: -self.sizes[i]):
            size = self.sizes[i]
            while above := self.some >> size:
                r = size + (above & -above).bit_length() - 1
                stack = self.at[r]
                while stack and self.room.get(stack[-1]) != r:
                    stack.pop()
                if not stack:
                    self.some &= ~(1 << r)
                    continue
                k = stack.pop()
                self.bins[k].append(i)
                self.room[k] = r - size
                self._list(k)
                break
            else:
                self.add_bin([i])

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first; then bins filled as unevenly as can be (sum of squares)."""
        return -len(self.bins), sum((self.capacity - r) ** 2 for r in self.room.values())

    def labels(self) -> list[int]:
        out = [0] * len(self.sizes)
        for n, items in enumerate(self.bins.values()):
            for i in items:
                out[i] = n
        return out


def from_labels(labels, sizes: list[int], capacity: int) -> Grouping:
    bins: dict[int, list[int]] = {}
    for i, n in enumerate(labels):
        bins.setdefault(n, []).append(i)
    out = Grouping(sizes, capacity)
    for items in bins.values():
        out.add_bin(items)
    return out


def cross(a: Grouping, b: Grouping, rng: random.Random, share: float = 0.3) -> Grouping:
    """b's well-filled bins injected into a; bins with duplicates removed, displaced items best-fitted."""
    ranked = sorted(b.bins, key=lambda k: b.room[k])
    pool = ranked[:max(1, len(ranked) // 2)]
    given = [b.bins[k] for k in rng.sample(pool, max(1, int(share * len(pool))))]
    moved = {i for items in given for i in items}
    child, displaced = Grouping(a.sizes, a.capacity), []
    kept = []
    for items in a.bins.values():
        if moved.isdisjoint(items):
            kept.append(items)
        else:
            displaced += [i for i in items if i not in moved]
    # the emptiest of the kept bins are opened too, so that displaced items can find new partners
    kept.sort(key=lambda items: -sum(a.sizes[i] for i in items))
    opened = max(1, len(kept) // 20)
    for items in given + kept[:-opened]:
        child.add_bin(items)
    child.best_fit(displaced + [i for items in kept[-opened:] for i in items])
    return child


def evolve(sizes: list[int], capacity: int, population: list, generations: int, members: int, seed: int) -> list:
    """Population (label lists, best first) after ``generations`` crossovers; rests at the fewest possible bins."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people = [from_labels(p, sizes, capacity) for p in population]
    if not people:
        first = Grouping(sizes, capacity)
        first.best_fit(list(range(len(sizes))))
        people = [first]
    while len(people) < members and len(people[0].bins) > least:
        other = Grouping(sizes, capacity)
        order = list(range(len(sizes)))
        rng.shuffle(order)
        half = order[:len(order) // 2]
        other.best_fit(half)
        other.best_fit(order[len(half):])
        people.append(other)
    people.sort(key=Grouping.fitness, reverse=True)
    for _ in range(generations):
        if len(people[0].bins) <= least or len(people) < 2:
            break
        a, b = rng.sample(people, 2)
        child = cross(a, b, rng)
        if child.fitness() > people[-1].fitness():
            people[-1] = child
            people.sort(key=Grouping.fitness, reverse=True)
    return [p.labels() for p in people]


def _epoch(islands: DataFrame, capacity: int, generations: int, members: int, epoch: int) -> DataFrame:
    def run(frames):
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                people = [list(p) for p in row.people]
                sizes = [int(x) for x in row.sizes]
                people = evolve(sizes, capacity, people, generations, members,
                                seed=int(row.block) * 1_000_003 + int(row.island) * 1009 + epoch)
                bins, squares = from_labels(people[0], sizes, capacity).fitness()
                out.append((row.block, row.island, row.keys, row.sizes, people, bins, squares))
            import pandas as pd

            yield pd.DataFrame(out, columns=["block", "island", "keys", "sizes", "people", "bins", "squares"])

    return islands.select("block", "island", "keys", "sizes", "people").mapInPandas(
        run, "block long, island int, keys array<long>, sizes array<int>, people array<array<int>>, bins long, "
             "squares long")


def _migrate(islands: DataFrame, count: int) -> DataFrame:
    """Each island's elite joins the next island's population, in place of its worst member."""
    elite = islands.select("block", F.pmod(F.col("island") + 1, F.lit(count)).cast("int").alias("island"),
                           F.col("people")[0].alias("elite"))
    shorter = F.when(F.size("people") > 1, F.expr("slice(people, 1, size(people) - 1)")).otherwise(F.col("people"))
    return islands.join(elite, ["block", "island"]).withColumn(
        "people", F.array_distinct(F.concat(F.array("elite"), shorter)))


def _place(best: DataFrame, capacity: int, full: float, share: float) -> DataFrame:
    """The elite's bins as rows: sequence_id is a bin's smallest piece key, offsets follow the keys.

    ``open`` marks the emptiest ``share`` of a block's bins, as far as they are not ``full``.
    """

    def run(frames):
        import pandas as pd

        for f in frames:
            for row in f.itertuples(index=False):
                keys, sizes = np.asarray(row.keys, np.int64), np.asarray(row.sizes, np.int64)
                bins = np.asarray(row.elite, np.int64)
                order = np.lexsort((keys, bins))
                keys, sizes, bins = keys[order], sizes[order], bins[order]
                begins = np.r_[True, bins[1:] != bins[:-1]]
                which = np.cumsum(begins) - 1
                before = np.cumsum(sizes) - sizes
                first = np.flatnonzero(begins)
                fill = np.bincount(which, sizes)
                emptiest = np.argsort(np.argsort(fill, kind="stable"), kind="stable") < max(1, int(share * len(fill)))
                yield pd.DataFrame({"piece_key": keys, "length": sizes, "sequence_id": keys[first][which],
                                    "offset": before - before[first][which],
                                    "open": (emptiest & (fill < full * capacity))[which]})

    return best.select("keys", "sizes", "elite").mapInPandas(run, PLACED)


def place(items: DataFrame, capacity: int = 2048, block_items: int = 4096, islands: int = 2, epochs: int = 2,
          generations: int = 10, members: int = 4, full: float = 0.99, share: float = 0.25) -> DataFrame:
    """sequence_id and offset of every (piece_key, length) row; lengths are at most ``capacity``."""
    spark = items.sparkSession
    done, left = [], items.select("piece_key", F.col("length").cast("long").alias("length"))
    count = left.count()
    while blocks := -(-count // block_items):
        # dealt in turn along the sorted lengths, so that all blocks have the same mix of them
        ranged = left.repartitionByRange("length", "piece_key").sortWithinPartitions("length", "piece_key")
        turn = F.monotonically_increasing_id() % F.lit(1 << 33) + F.spark_partition_id()
        dealt = ranged.select("*", F.pmod(turn, F.lit(blocks)).cast("long").alias("block")).groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("piece_key", "length"))).alias("x"))
        now = dealt.select("block", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"),
                           F.col("x.piece_key").alias("keys"), F.col("x.length").cast("array<int>").alias("sizes"),
                           F.expr("cast(array() as array<array<int>>)").alias("people"))
        paths = []
        for epoch in range(epochs):
            # each island is a task's work of its own, whatever block its rows came from
            spread = (_migrate(now, islands) if epoch else now).repartition("block", "island")
            now, path = stage(_epoch(spread, capacity, generations, members, epoch), "packing-islands")
            paths.append(path)
        best = now.groupBy("block").agg(F.max_by(
            F.struct("keys", "sizes", F.col("people")[0].alias("elite")), F.struct("bins", "squares")).alias("b"))
        placed, _ = stage(_place(best.select("b.*"), capacity, full, share), "packing-placed")
        discard(spark, *paths)
        if blocks == 1:
            done.append(placed)
            break
        done.append(placed.where("not open"))
        opened = placed.where("open")
        left = opened.select("piece_key", "length")
        before, count = count, left.count()
        if count > before * LESS:
            # bins of many small pieces: the open bins themselves are packed on, if they are fewer than their pieces
            bins, _ = stage(opened.groupBy(F.col("sequence_id").alias("piece_key")).agg(F.sum("length").alias("length")),
                            "packing-bins")
            if 2 * bins.count() <= count:
                outer = place(bins, capacity, block_items, islands, epochs, generations, members, full, share).select(
                    F.col("piece_key").alias("inner"), F.col("sequence_id").alias("outer"), F.col("offset").alias("ahead"))
                opened = opened.join(outer, opened["sequence_id"] == outer["inner"]).select(
                    "piece_key", "length", F.col("outer").alias("sequence_id"),
                    (F.col("ahead") + F.col("offset")).alias("offset"), "open")
            done.append(opened)
            break
    if not done:
        return items.select("piece_key", F.col("piece_key").alias("sequence_id"),
                            F.lit(0).cast("long").alias("offset")).where("false")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("piece_key", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text",
         **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = pieces_of(docs, tokenizer_path, capacity, doc_id, text) \
        .withColumn("piece_key", F.monotonically_increasing_id())
    pieces, _ = stage(pieces, "packing-pieces")
    whole = pieces.where(F.col("length") == capacity).select(
        "*", F.col("piece_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    placed = place(rest.select("piece_key", "length"), capacity, **options)
    return whole.unionByName(rest.join(placed, "piece_key")).drop("piece_key")
