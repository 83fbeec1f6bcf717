"""Document fingerprints: SimHash of weighted terms, and block tables that find all within a Hamming radius.

DataFrame functions only.  A text's terms are its words (cut after 16
characters) and pairs of adjacent words; a word weighs its length beyond
three characters, five at most, a pair weighs three.  Every term is hashed to
``64 * WORDS`` bits, and each hash votes on every bit with its term's weight:
a bit is 1 if more than half of the weight votes for it.  Votes are plain sums:
bits j, j + 16, j + 32 and j + 48 of a hash are added as the four 16-bit lanes of
one long, for stretches of 2048 words, which are then added in 32-bit lanes that
hold any text that a row can.

:func:`within` finds the fingerprints within ``radius`` bits of each query: the
bits are cut into blocks, and every choice of ``blocks - radius`` of them is a
table keyed by the chosen blocks, as if these were permuted to the front; by
the pigeonhole principle two fingerprints that differ in at most ``radius``
bits agree in the key of some table.  A pair is counted in the first such table
only.  Equal fingerprints are one row with a count, so copies never meet in
pairs, and only queries meet all rows.

:func:`edited_pairs` sets each document beside its text with the second half
replaced by the beginning of the next document.  The order of documents is a
ring of numbers over ids and digests; a document sends the other only the
characters that it needs.

Defined cases: a null text is empty; a text without words has fingerprint 0; a
very long text is one row, whose terms stream through one task's sums; repeated
rows are returned as often as given and count as one document in the order, in
which rows of one id follow their digests and null ids come last; the only
document of a table is its own next; an empty table gives an empty result; only
the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.llm.common import stage
from crease.operators.keys import consecutive_ids

WORDS = 4
LONGEST, FREE, MOST, PAIR = 16, 3, 5, 3
STRETCH = 2048  # words whose weights fit a 16-bit lane, also the uppermost one, which has the sign
ONES = sum(1 << k for k in (0, 16, 32, 48))
WIDE = 0xFFFF | 0xFFFF << 32
WORD = rf"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{{1,{LONGEST}}}"


def terms(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, part, word and pair (hashes), word_weight and pair_weight: a row per word, one without weight for no words.

    ``part`` numbers stretches of ``STRETCH`` words.
    """
    words = texts.select(*keys, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("w"))
    pairs = F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("v"))
    rows = words.select(*keys, F.posexplode_outer(pairs).alias("at", "x")).select(*keys, "at", "x.w", "x.v")
    return rows.select(
        *keys, F.shiftright("at", STRETCH.bit_length() - 1).alias("part"), F.xxhash64("w").alias("word"),
        F.xxhash64("w", "v").alias("pair"),
        F.coalesce(F.least(F.greatest(F.length("w") - FREE, F.lit(0)), F.lit(MOST)), F.lit(0)).cast("long")
        .alias("word_weight"),
        F.when(F.col("v").isNotNull(), F.lit(PAIR)).otherwise(F.lit(0)).cast("long").alias("pair_weight"))


def votes(texts: DataFrame, keys: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """keys and f0, f1, ..: the fingerprint of every row of ``texts`` as longs; ``keys`` tell its rows apart."""
    rows = terms(texts, keys, text)
    hashes = [(F.col(k) if i == 0 else F.xxhash64(k, F.lit(i))).alias(f"{k}{i}")
              for k in ("word", "pair") for i in range(words)]
    rows = rows.select(*keys, "part", "word_weight", "pair_weight", *hashes)

    def lanes(k: str, j: int, mask: int) -> Column:
        return (F.shiftrightunsigned(k, j) if j else F.col(k)).bitwiseAND(F.lit(mask))

    weight = F.sum(F.col("word_weight") + F.col("pair_weight")).alias("weight")
    narrow = rows.groupBy(*keys, "part").agg(weight, *[
        F.sum(F.col("word_weight") * lanes(f"word{i}", j, ONES) + F.col("pair_weight") * lanes(f"pair{i}", j, ONES))
        .alias(f"s{i}_{j}") for i in range(words) for j in range(16)])
    wide = narrow.groupBy(*keys).agg(F.sum("weight").alias("weight"), *[
        F.sum(lanes(f"s{i}_{j}", half, WIDE)).alias(f"s{i}_{j + half}")
        for i in range(words) for j in range(16) for half in (0, 16)])

    def bit(i: int, j: int) -> Column:  # bits j < 32 are low lanes, the others high ones
        total = F.col(f"s{i}_{j % 32}")
        total = F.shiftrightunsigned(total, 32) if j >= 32 else total.bitwiseAND(F.lit((1 << 32) - 1))
        return F.when(2 * total > F.col("weight"), F.lit((1 << j) - ((1 << 64) if j == 63 else 0))) \
            .otherwise(F.lit(0)).cast("long")

    return wide.select(*keys, *[reduce(Column.bitwiseOR, [bit(i, j) for j in range(64)]).alias(f"f{i}")
                                for i in range(words)])


def hexed(names: list[str]) -> Column:
    """The longs as one string of lower-case hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in names]))


def differing(a: list[str], b: list[str]) -> Column:
    """Number of differing bits."""
    return reduce(Column.__add__, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)])


def likeness(a: list[str], b: list[str]) -> Column:
    """Cosine of the term vectors as the fingerprints tell it, 0 for unlike ones: 1 for equal fingerprints."""
    angle = differing(a, b) * F.lit(3.141592653589793 / (64 * len(a)))
    return F.when(differing(a, b) == 0, F.lit(1.0)).otherwise(F.greatest(F.cos(angle), F.lit(0.0)))


def block_masks(words: int, radius: int, blocks: int) -> list[list[int]]:
    """For each table its key's bits as one (signed) mask a word; tables are choices of ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [round(64 * words * k / blocks) for k in range(blocks + 1)]
    block = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    out = []
    for chosen in combinations(block, blocks - radius):
        whole, each = sum(chosen), []
        for i in range(words):
            m = whole >> (64 * i) & ((1 << 64) - 1)
            each.append(m - (1 << 64) if m >> 63 else m)
        out.append(each)
    return out


def within(queries: DataFrame, classes: DataFrame, words: int = WORDS, radius: int = 7,
           blocks: int | None = None) -> DataFrame:
    """f0, f1, .. of distinct ``queries`` and n_within: rows of ``classes`` (f0, f1, .., copies) within the radius.

    All of them are found, whatever the size of a table's bucket.
    """
    names, others = [f"f{i}" for i in range(words)], [f"g{i}" for i in range(words)]
    masks = block_masks(words, radius, blocks or radius + 1)

    def tables(df: DataFrame, rest: list[Column]) -> DataFrame:
        keys = [F.xxhash64(F.lit(t), *[F.col(n).bitwiseAND(F.lit(m)) for n, m in zip(names, mask, strict=True) if m])
                for t, mask in enumerate(masks)]
        return df.select(*rest, F.posexplode(F.array(*keys)).alias("t", "key"))

    left = tables(queries.select(*names).distinct(), [F.col(n) for n in names])
    right = tables(classes, [F.col(n).alias(g) for n, g in zip(names, others, strict=True)] + [F.col("copies")])
    right = right.withColumnRenamed("t", "u")

    def agree(mask: list[int]) -> Column:
        return reduce(Column.__and__, [F.col(n).bitwiseXOR(F.col(g)).bitwiseAND(F.lit(m)) == 0
                                       for n, g, m in zip(names, others, mask, strict=True) if m])

    first = F.lit(True)  # no earlier table has the pair
    for t, mask in enumerate(masks[:-1]):
        first = first & ((F.col("t") <= t) | ~agree(mask))
    near = (left["key"] == right["key"]) & (F.col("t") == F.col("u")) & (differing(names, others) <= radius) & first
    return left.join(right, near).groupBy(*names).agg(F.sum("copies").alias("n_within"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row, n_chars, text and edited of every row; and, staged, the ring: key, doc_id, next_key."""
    keyed = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                        F.col(doc_id).cast("long").alias("doc_id"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text"))
    keyed = keyed.withColumn("key", F.unhex(F.sha2(name.cast("binary"), 256)))
    light = keyed.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"),
                                     F.count("*").alias("copies"))
    light = consecutive_ids(light, [F.col("doc_id").desc_nulls_last(), F.col("key")], start=0, id_col="k")
    light, _ = stage(light, "fingerprints-order")
    total = light.select(F.count("*")).scalar()
    ahead = light.select(((F.col("k") + 1) % total).alias("k"), F.col("key").alias("to"),
                         F.expr("n div 2").cast("int").alias("want"))
    after = light.select(((F.col("k") - 1 + total) % total).alias("k"), F.col("key").alias("next_key"))
    ring, _ = stage(light.join(ahead, "k").join(after, "k").drop("k"), "fingerprints-ring")

    placed = keyed.select("key", "text").join(ring, "key")
    sent = placed.select(F.col("to").alias("key"), F.expr("substring(text, 1, want)").alias("head"), "copies")
    # equal rows of one id send one head
    sent = sent.where("copies = 1").select("key", "head").unionByName(
        sent.where("copies > 1").groupBy("key").agg(F.max("head").alias("head")))
    own = placed.select("key", F.col("n").alias("n_chars"), "text")
    both = own.join(sent, "key").select(
        "key", F.monotonically_increasing_id().alias("row"), "n_chars", "text",
        F.expr("concat(substring(text, 1, n_chars - n_chars div 2), head)").alias("edited"))
    return both, ring.select("key", "doc_id", "next_key")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                      radius: int = 7, every: int = 50) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_within of every row.

    ``n_within`` is for ids divisible by ``every``, else null: how many rows of the
    table, itself included, have a fingerprint within ``radius`` bits.
    """
    both, ring = edited_pairs(docs, doc_id, text)
    keys = ["key", "row", "n_chars", "edited_sha256"]
    two = both.select("key", "row", "n_chars", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"),
                      F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")),
                                        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    told = votes(two.select(*keys, "x.kind", "x.text"), [*keys, "kind"], words=words)
    f, e, g = ([f"{x}{i}" for i in range(words)] for x in "feg")
    wide = told.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col(f"f{i}"))).alias(n[i])
                                     for k, n in ((0, f), (1, e)) for i in range(words)])
    fps, _ = stage(wide, "fingerprints")

    classes = fps.groupBy(*f).agg(F.count("*").alias("copies"))
    asked = fps.join(ring.where(F.col("doc_id") % every == 0), "key").select(*f)
    found = within(asked, classes, words, radius).withColumnsRenamed({a: f"q{a}" for a in f})
    follow = fps.groupBy("key").agg(*[F.max(a).alias(b) for a, b in zip(f, g, strict=True)])
    rows = fps.join(ring, "key").join(follow.withColumnRenamed("key", "next_key"), "next_key")
    same = reduce(Column.__and__, [F.col(a) == F.col(f"q{a}") for a in f])
    return rows.join(found, same, "left").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"), hexed(f).alias("fingerprint"),
        hexed(e).alias("edited_fingerprint"), likeness(f, e).alias("near_edited"), likeness(f, g).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n_within")).alias("n_within"))
