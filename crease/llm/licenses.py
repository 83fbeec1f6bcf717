"""Licence scans with DataFrame functions only: ordered signatures, prefiltered and resolved.

Most documents have none of the gate words and pass unscanned.  The others
become canonical text (A-Z lower-cased, words with one space between).  Only
rules of which a keyword begins a word in it are tried, and each that matches gives
the lengths of the stretches between its matches and of the matches.  Running
sums turn these into intervals, and a detection whose interval lies within one
of the same or a higher priority is suppressed.  The strongest detection that
is left gives the score.

Apart from the whole texts' single pass only small rows move: detections, and
a row of counts per document.  Window groups hold one document's detections.

Defined cases: null text is empty; repeated rows and null ids are returned as
given; documents without words have null places; places of different phrases
may overlap, and a phrase may overlap itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.llm.common import stage
from crease.llm.license_rules import Rule, rules

#: the base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: characters between words, one by one: a class of single characters is a look-up, one of ranges is not
GAP = "[" + "".join(rf"\x{c:02X}" for c in range(0x80) if not chr(c).isalnum()) + "]"
#: what stands between words, but for a single space, which can stay as it is
UNEVEN = rf"{GAP}(?:(?<! )|(?={GAP})){GAP}*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spread(lowered: Column) -> Column:
    """'^ ' and each word of a lower-cased text with a space behind it."""
    return F.concat(F.lit("^ "), F.ltrim(F.regexp_replace(F.concat(lowered, F.lit(" ")), UNEVEN, " ")))


def canonical(text: Column) -> Column:
    return spread(F.translate(text, UPPER, LOWER))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def gates(phrases: dict[str, str], ordered: list[Rule]) -> list[list[list[str]]]:
    """Groups of words: a text in which any phrase or signature stands has a word of each group of one gate at least.

    Rules of one group share a gate; those of two share one if their first group is the same.
    """
    single = {max(p.split(), key=len) for p in phrases}
    double: dict[tuple, set] = {}
    for r in ordered:
        first, *rest = r.gate
        if rest:
            double.setdefault(first, set()).update(rest[0])
        else:
            single.update(first)
    return [[sorted(single)], *([sorted(a), sorted(b)] for a, b in double.items())]


def any_of(words) -> str:
    """Regex of the words (letters and digits) by their common beginnings; characters with the same rest share a class."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def regex(node: dict) -> str:
        by_rest: dict[str, list[str]] = {}
        for c in sorted(c for c in node if c):
            by_rest.setdefault(regex(node[c]), []).append(c)
        ways = [("".join(cs) if len(cs) == 1 else f"[{''.join(cs)}]") + rest for rest, cs in by_rest.items()]
        if "" not in node:
            return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{'|'.join(ways)})?" if ways else ""

    return regex(tree)


def _gate(spaced: Column, phrases: dict[str, str], ordered: list[Rule]) -> Column:
    """Whether the words of a text pass a gate, by literal patterns: no array of the words is made."""
    def holds(words) -> Column:
        return F.regexp_like(spaced, F.lit(f" {any_of(words)} "))

    every = gates(phrases, ordered)
    out = F.lit(False)
    for groups in every:
        out = out | reduce(and_, map(holds, groups))
    # most texts have no word of any gate's first group: one pass
    return holds(sorted({w for first, *_ in every for w in first})) & out


def _rule_groups(ordered: list[Rule]) -> Column:
    """The rules as a literal: beginnings of words -> array of (rule number, pattern)."""
    by_key: dict[tuple, list] = {}
    for n, r in enumerate(ordered):
        by_key.setdefault(r.keywords, []).append(F.struct(
            F.lit(n).alias("n"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern")))
    return F.array(*[F.struct(F.array(*[F.lit(f" {k}") for k in keys]).alias("keys"), F.array(*v).alias("rules"))
                     for keys, v in by_key.items()])


def _lengths(canon: Column, ordered: list[Rule]) -> Column:
    """For each rule that matches: the lengths between its matches, and of them."""
    groups = F.filter(_rule_groups(ordered), lambda g: F.exists(g["keys"], lambda k: F.contains(canon, k)))
    gated = F.flatten(F.transform(groups, lambda g: g["rules"]))
    found = F.filter(gated, lambda r: F.regexp_like(canon, r["pattern"]))
    return F.transform(found, lambda r: F.struct(
        r["n"].alias("n"),
        F.transform(F.split(canon, r["pattern"], -1), lambda x: F.length(x)).alias("gaps"),
        F.transform(F.regexp_extract_all(canon, r["pattern"], F.lit(0)), lambda x: F.length(x)).alias("hits")))


def detections(scanned: DataFrame, ordered: list[Rule]) -> DataFrame:
    """row, start, stop (characters of canonical text), label, priority, weight of what is not suppressed."""
    # the rules as literals: rows made on the driver would start Python workers on the executors
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
                               F.lit(r.weight).alias("weight")) for r in ordered])
    each = scanned.select("row", F.explode("found").alias("f"))
    # the stretch behind a rule's last match has no match: posexplode of hits leaves it out
    each = each.select("row", "f.n", "f.gaps", F.posexplode("f.hits").alias("k", "hit"))
    each = each.select("row", "n", "k", "hit", F.expr("gaps[k]").alias("gap"))
    along = Window.partitionBy("row", "n").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.select("row", "n", (F.sum(F.col("gap") + F.col("hit")).over(along)).alias("stop"), "hit")
    spans = spans.select("row", "n", (F.col("stop") - F.col("hit")).alias("start"), "stop", table[F.col("n")].alias("r"))
    spans = spans.select("row", "n", "start", "stop", "r.label", "r.priority", "r.weight")
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("priority"), "n") \
        .rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted({r.priority for r in ordered}):
        reach = F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(before)
        covered = covered | ((F.col("priority") == p) & (F.coalesce(reach, F.lit(-1)) >= F.col("stop")))
    return spans.withColumn("_covered", covered).where("not _covered") \
        .select("row", "start", "stop", "label", "priority", "weight")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
         ordered: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    phrases, ordered = phrases or PHRASES, ordered or rules()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # lower() also changes letters beyond A-Z, but never the places where words begin and end, nor an ASCII word
    rows = rows.withColumn("spaced", spread(F.lower("text")))
    rows = rows.select("row", "doc_id", (spaces(F.col("spaced")) - 1).cast("long").alias("n_words"),
                       F.when(_gate(F.col("spaced"), phrases, ordered), canonical(F.col("text"))).alias("canon"))
    canon = F.col("canon")
    either = F.lit("(?= (?:" + "|".join(phrases) + ") )")
    places = {p: F.regexp_count(canon, F.lit(f"(?= {p} )")) for p in phrases}
    named = [F.when(n > 0, F.lit(phrases[p])) for p, n in places.items()]
    rows = rows.withColumn("at", F.when(F.regexp_like(canon, either), F.split(canon, either, -1)))
    rows = rows.select(
        "row", "doc_id", "n_words",
        F.coalesce(sum(places.values(), F.lit(0)).cast("long"), F.lit(0)).alias("n_base"),
        spaces(F.element_at("at", 1)).cast("long").alias("first_word"),
        (F.col("n_words") + 1 - spaces(F.element_at("at", -1))).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))).alias("base"),
        F.when(canon.isNotNull(), _lengths(canon, ordered)).alias("found"))
    scanned, _ = stage(rows, "licenses")
    own = detections(scanned.where(F.size("found") > 0), ordered).groupBy("row") \
        .agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))
    none = F.expr("cast(array() as array<string>)")
    return scanned.drop("found").join(own, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("weight", F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"))
