"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint is the bitwise majority of the XXH64 hashes (seed 42)
of its word shingles.  Two fingerprints link at ``max_bits`` or fewer differing
bits; linked documents form components.

Candidates come from the pigeonring principle: cut 64 bits into a ring of m
segments; if two fingerprints differ in at most t bits, some segment starts a
chain whose first l segments differ in at most l*t/m bits, for every l.  The
chain's budget is 0 as long as l*t < m, so that many consecutive segments are
equal: they are the join key.  The budgets of all longer chains are tested in
the join condition, and the last of them (l = m) is the full Hamming check.

Links are searched between distinct fingerprints only, so copies never meet
as pairs.  A bucket (equal chain) of more than ``bucket_rows`` fingerprints is
not joined with itself.  Its fingerprints go an exact way of linear cost: for
t <= 2, two fingerprints link just if they have a common neighbour at distance
ceil(t/2) or less, so each is hung on the smallest fingerprint that shares one
of its neighbours.

Defined cases: null text is the empty text; a text without words has
fingerprint 0 and links like any other; fewer words than a shingle make one
shingle of all; repeated rows are returned as often as given; null doc_ids get
a fingerprint and the component's smallest id, but never name a component
unless all of its ids are null; an empty table gives an empty result; only the
id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from crease.llm.common import stage
from crease.llm.components import components

SEED = 42
BLOCK_WORDS = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash; words are split at ASCII white space and only A-Z is lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK_WORDS):
        part = words[start:start + BLOCK_WORDS + shingle - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprinted(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with the text in their last column replaced by fp, its fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.columns[-1]], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], [*b.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("fp", LongType())]))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""
    return _fingerprinted(docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                                      F.col(text).cast("string").alias("text")), shingle)


def ring(max_bits: int, segments: int) -> tuple[list[list[int]], list[int]]:
    """masks[i][l-1]: bits of the l segments from i on, round the ring; budgets[l-1]: their most differing bits."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    seg = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(segments)]
    masks, budgets = [], [length * max_bits // segments for length in range(1, segments + 1)]
    for i in range(segments):
        chain, row = 0, []
        for length in range(segments):
            chain |= seg[(i + length) % segments]
            row.append(chain)
        masks.append(row)
    return masks, budgets


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2, segments: int = 7, bucket_rows: int = 64) -> DataFrame:
    """(a, b) edges between distinct fingerprints whose components are those of all links.

    ``fps`` has distinct longs in column fp.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the exact way for large buckets covers 0 to 2 bits")
    masks, budgets = ring(max_bits, segments)
    first = max(k for k, budget in enumerate(budgets) if budget == 0) if max_bits else segments - 1
    keys = [F.col("fp").bitwiseAND(F.lit(_signed(masks[i][first]))) for i in range(segments)]
    spread = fps.select("fp", F.posexplode(F.array(*keys)).alias("i", "key"))
    sizes = spread.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets, _ = stage(spread.join(sizes, ["i", "key"]), "simhash-buckets")

    small = buckets.where(F.col("n") <= bucket_rows)
    mask = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in masks])
    left = small.select(F.col("i").alias("i"), F.col("key").alias("key"), F.col("fp").alias("a"))
    right = small.select(F.col("i").alias("j"), F.col("key").alias("same"), F.col("fp").alias("b"))
    near = F.expr("i = j and key = same and a < b")
    for length in range(first + 1, segments):
        chain = F.element_at(F.element_at(mask, F.col("i") + 1), length + 1)
        near &= F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(chain)) <= budgets[length]
    pairs = left.join(right, near).select("a", "b")

    # any two members of a large bucket: 1-bit neighbours meet (themselves only, for 0 bits)
    crowd = buckets.where(F.col("n") > bucket_rows).select("fp").distinct()
    flips = [0] + ([_signed(1 << k) for k in range(64)] if max_bits else [])
    around = crowd.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"), (F.col("flip") == 0).alias("own"))
    if max_bits == 1:  # at 1 bit only a fingerprint itself links its neighbours
        centre = around.where("own").select(F.col("fp").alias("b"), "near")
        stars = around.join(centre, "near").select(F.col("fp").alias("a"), "b")
    else:
        centre = around.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        stars = around.join(centre, "near").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars.where("a <> b")).distinct()


def roots(rows: DataFrame, max_bits: int, segments: int, bucket_rows: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint in ``rows``, staged; linked fingerprints share their root."""
    classes = rows.select("fp").distinct()
    tree = components(links(classes, max_bits, segments, bucket_rows))
    named = classes.join(tree, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return stage(named, "simhash-roots")[0]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                    max_bits: int = 2, segments: int = 7, bucket_rows: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row."""
    rows, _ = stage(fingerprints(docs, doc_id, text, shingle), "simhash")
    named = roots(rows, max_bits, segments, bucket_rows)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))  # copies meet as one row before any join
    least = least.join(named, "fp")
    groups = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = least.join(groups, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2,
                segments: int = 7, bucket_rows: int = 64) -> DataFrame:
    """One row of every component, with the columns of ``docs``: that with the smallest id (null ids last)."""
    # staged with row numbers: decisions are about rows, also where ids repeat or are null
    rows, _ = stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                                F.monotonically_increasing_id().alias("row")), "simhash-docs")
    # whole rows stay in the JVM: no task holds them for Python, back from Python and for a file at once
    light, _ = stage(_fingerprinted(rows.select("row", F.col(f"doc.`{doc_id}`").alias("id"),
                                                F.col(f"doc.`{text}`").cast("string").alias("text")), shingle), "simhash")
    named = roots(light, max_bits, segments, bucket_rows)
    first = light.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")).join(named, "fp")
    keep = first.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    # the dropped rows are fewer than the kept ones: their true size decides whether Spark broadcasts them
    drop, _ = stage(light.select("row").join(keep, "row", "left_anti"), "simhash-drop")
    return rows.join(drop, "row", "left_anti").select("doc.*")
