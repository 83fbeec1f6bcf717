"""Spelling variants: words one edit apart, each grouped under its most frequent variant.

:func:`near_words` finds all pairs of a vocabulary that differ by exactly one
inserted, deleted or replaced code point, by dynamic programming over sorted
lists: a list is scanned once for each of its words, and the three-cell rows of
the banded edit matrix are kept for every prefix, so a word reuses the rows of
the prefix that it shares with the word before (their LCP).  When every cell of
a row exceeds one edit, the whole range of words that share that prefix is
skipped with one binary search.

A list is the words that can differ only inside a window.  Take the shorter
length m of a pair and its first differing place p (m if the shorter is a
prefix): the pair agrees before p and behind the edit.  The windows [0, m/2) and
[m/2, m) cover all p, so a word enters the lists of its own length and of one
less, keyed by what lies outside the window; a pair is counted in the list whose
window holds its p, and only there.  A list of more than ``list_words`` words is
replaced by those of its window's halves, again and again: in a window of one
place words differ by one or two code points, which bounds the list by the
alphabet.  No list is ever collected beyond that, and none is cut.

:func:`group_words` names a word's *form*, its near word of largest count (ties:
smallest in code-point order) if that has at least ``ratio`` times its own
count, and its *root*, the end of its chain of forms.  Counts grow along a
chain, so it has no cycle and is short; pointer doubling follows all chains at
once.

Defined cases (:func:`variants`): a null text has no words; a null id counts as
an empty one; a very long text is one row of the word count; repeated rows count
as often as given; ties are broken as above; a word without near words is its
own root; an empty table gives an empty result; only the id and text columns are
read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import discard, stage

SHORTEST, EVERY, RATIO = 7, 31, 10
LAST = chr(0x10FFFF)
DEAD = 2


def shared_prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def next_row(row: tuple, query: str, depth: int, char: str) -> tuple:
    """The banded row of a prefix of ``depth`` code points that ends with ``char``.

    A row holds the edits between the prefix and the query's first depth - 1,
    depth and depth + 1 code points, more than one counted as two.
    """
    x, y, z = row
    size = len(query)
    left = min(x + (query[depth - 2] != char), y + 1, DEAD) if 2 <= depth <= size + 1 else min(y + 1, DEAD)
    mid = min(y + (query[depth - 1] != char), z + 1, left + 1, DEAD) if depth <= size else DEAD
    right = min(z + (query[depth] != char), mid + 1, DEAD) if depth < size else DEAD
    return left, mid, right


def near_in_list(words: list[str], shorter: int, stop: int):
    """(a, b) of a sorted list's words one edit apart, a < b, that first differ before place ``stop``.

    One of the two has ``shorter`` code points, the other as many or one more.
    """
    lcp = [0, *map(shared_prefix, words, words[1:])]
    for a, query in enumerate(words):
        size, b = len(query), a + 1
        rows = [(1, 0, 1)] * size + [(1, 0, DEAD)]  # the query's own prefixes
        rows[0] = (DEAD, 0, 1)
        same = valid = size
        while b < len(words):
            valid, same = min(valid, lcp[b]), min(same, lcp[b])
            word, row = words[b], rows[valid]
            del rows[valid + 1:]
            for depth in range(valid + 1, len(word) + 1):
                row = next_row(row, query, depth, word[depth - 1])
                if min(row) >= DEAD:
                    valid = depth - 1
                    b = bisect_right(words, word[:depth] + LAST, b + 1)
                    break
                rows.append(row)
            else:
                valid = len(word)
                off = size - len(word)
                if -1 <= off <= 1 and row[off + 1] == 1 and same < stop and min(size, len(word)) == shorter:
                    yield a, b
                b += 1


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
                every: int = EVERY, least: int = 2) -> DataFrame:
    """word and n of every word of at least ``shortest`` code points and ``least`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  A
    run loses a code point if ``every`` divides the crc32 h of "id:run", that at
    place h modulo its length.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        F.col(text).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = "cast(h % length(run) as int)"
    cut = F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _listed(rows: DataFrame) -> DataFrame:
    """word, n, m, i, j and key: the list of the words that agree with it outside the window [i, j)."""
    outside = "concat_ws('.', m, i, j, concat(substring(word, 1, i), substring(word, length(word) - (m - j) + 1)))"
    return rows.withColumn("key", F.expr(outside))


def _lists(words: DataFrame, list_words: int) -> DataFrame:
    """Every word's rows in its lists, none of them too long."""
    spark = words.sparkSession
    shortest = words.select(F.min(F.length("word"))).scalar()
    rows = words.select("word", "n", F.explode(F.array(F.length("word") - 1, F.length("word"))).alias("m"))
    rows = rows.where((F.col("m") > 0) & (F.col("m") >= shortest))
    whole = rows.select("word", "n", "m", F.lit(0).alias("i"), F.col("m").alias("j"))
    out = None
    while True:
        halves = whole.select("word", "n", "m", F.explode(F.expr(
            "array(struct(i, i + (j - i) div 2 as j), struct(i + (j - i) div 2 as i, j))")).alias("w"))
        rows = _listed(halves.select("word", "n", "m", F.col("w.i").cast("int").alias("i"),
                                     F.col("w.j").cast("int").alias("j")).where("i < j"))
        long_lists = rows.where("j - i > 1").groupBy("key").agg(F.count("*").alias("size")) \
            .where(F.col("size") > list_words).select("key")
        long_lists, path = stage(long_lists, "spelling-long")
        if not long_lists.limit(1).count():
            discard(spark, path)
            return rows if out is None else out.unionByName(rows)
        short = rows.join(long_lists, "key", "left_anti")
        out = short if out is None else out.unionByName(short)
        whole = rows.join(long_lists, "key", "left_semi").drop("key")


def near_words(words: DataFrame, list_words: int = 2000) -> DataFrame:
    """word, n_near, near and near_n of each distinct ``word`` (with its count n) that has near words.

    ``near`` is the near word of largest count, the smallest of equals.
    """
    spread = _lists(words, list_words).select("key", "m", "i", "j", "word", "n") \
        .repartition("key").sortWithinPartitions("key", "word")

    def lists(batches):
        """(m, j, words, counts) of each list; a list may go on in the next batch."""
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "m", "j", "word", "n")),
                                                strict=True))
        for _, group in groupby(rows, key=itemgetter(0)):
            _, m, j, found, n = zip(*group, strict=True)
            if len(found) > 1:
                yield m[0], j[0], list(found), n

    def run(batches):
        out = []
        for m, j, found, n in lists(batches):
            best: dict[int, list] = {}
            for pair in near_in_list(found, m, m + 1 if j == m else j):
                for a, b in (pair, pair[::-1]):
                    got, new = best.setdefault(a, [0, None]), (-n[b], found[b])
                    got[0] += 1
                    got[1] = new if got[1] is None else min(got[1], new)
            out.extend((found[a], count, near, -less) for a, (count, (less, near)) in best.items())
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    each = spread.mapInArrow(run, "word string, n_near long, near string, near_n long")
    least = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    top = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("top"))
    return top.select("word", "n_near", F.col("top.near").alias("near"), (-F.col("top.less")).alias("near_n"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    words, counts, near, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()),
                                       pa.array(near, pa.string()), pa.array(n, pa.int64())],
                                      ["word", "n_near", "near", "near_n"])


def chain_ends(forms: DataFrame) -> DataFrame:
    """word and root of every row of ``forms`` (word, form), which has no cycle: the last form of its chain."""
    spark = forms.sparkSession
    now, path = stage(forms.select("word", F.col("form").alias("root")), "spelling-chains")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left")
        if not step.where("next is not null").limit(1).count():
            return now
        nxt, nxt_path = stage(step.select("word", F.coalesce("next", "root").alias("root")), "spelling-chains")
        discard(spark, path)
        now, path = nxt, nxt_path


def group_words(words: DataFrame, ratio: int = RATIO, list_words: int = 2000) -> DataFrame:
    """word, form, root, n, n_near and form_n of each distinct ``word`` with count n."""
    near, _ = stage(words.join(near_words(words, list_words), "word", "left"), "spelling-near")
    named = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                        F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near")).alias("form"),
                        F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_n")).alias("form_n"))
    ends = chain_ends(named.where("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", list_words: int = 2000) -> DataFrame:
    """:func:`group_words` over the :func:`word_counts` of whole texts."""
    words, _ = stage(word_counts(docs, doc_id, text), "spelling-words")
    return group_words(words, list_words=list_words)
