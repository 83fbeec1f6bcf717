"""Licence signatures: every alternative is found through gate and prefilter."""

import random
import re
from re import _parser as sre

import pytest
from llm_session import workers  # noqa: F401

from crease.llm import licenses
from crease.llm.license_rules import rules

RESTORED = [
    ("about FreeBSD here", "bsd-2-clause", 0.5), ("a trade secret of Acme", "proprietary", 0.99),
    ("the trade secrets of Acme", "proprietary", 0.99), ("under MIT-0 here", "mit-0", 0.5),
    ("MIT No Attribution", "mit-0", 0.5), ("CC Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd", 0.5),
    ("CC Attribution NonCommercial ShareAlike", "cc-by-nc-sa", 0.5), ("distributed under MIT", "mit", 0.95),
    ("released under the BSD", "bsd", 0.95), ("available under ISC", "isc", 0.95),
    ("published according to the terms of the zlib", "zlib", 0.95), ("covered by the Artistic License", "artistic", 0.95),
    ("provided under the GNU General Public License, version 2", "gpl,gpl-2.0", 0.95),
]
PLAIN = ["mit available freunden", "released mit", "the mit lab, 1 attribution", "available under general terms"]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels, r.score) for r in sorted(licenses.scan(df).collect(), key=lambda r: r.doc_id)]


def test_restored_signatures(workers):
    got = found(workers, [t for t, *_ in RESTORED])
    assert got == [(label, pytest.approx(score)) for _, label, score in RESTORED]
    assert found(workers, PLAIN) == [("", 0.0)] * len(PLAIN)


BY_HAND = [
    ("Berkeley Software Distribution License", "bsd"), ("Q Public License", "qpl-1.0"), ("zero clause BSD", "0bsd"),
    ("for noncommercial use", "non-commercial"), ("nocommercial use", "non-commercial"),
    ("no part of this book may be copied without written permission", "proprietary"),
    ("under GPL3", "gpl-3.0"), ("under LGPL3", "lgpl-3.0"), ("under AGPL3", "agpl"), ("under MPL2", "mpl-2.0"),
    ("under EPL2", "epl"), ("under OFL1", "ofl-1.1"), ("Llama3 community license", "llama"),
    ("distributed under Apache2", "apache-2.0"), ("the Artistic License2", "artistic-2.0"),
    ("Tous droits réservés", "reserved"), ("TOUS DROITS RÉSERVÉS", "reserved"),
    ("tous droits réservés", "reserved"), ("tous droits reserves", "reserved"),
]


HEADERS = [
    ("Licensed under GPLv3", "gpl-3.0"), ("Licensed under the AGPLv3+.", "agpl"), ("GPLv2 or later", "gpl-2.0"),
    ("is licensed under the LGPLv2.1", "lgpl-2.1"), ("released under MPLv2.0", "mpl-2.0"),
    ("Apache License v2.0", "apache-2.0"), ("Apache Licensev2", "apache-2.0"), ("EPLv1.0", "epl"),
    ("Copyright \u00a9 2020 Foo Inc", "copyright"), ("Copyright (C) 1999, 2004 by Foo", "copyright"),
    ("\u00a9 2020 Foo Inc", "copyright"), ("\u00a92020 Foo Inc", "copyright"), ("copyrighted work", ""),
]


def test_spellings_of_headers(workers):
    assert [labels for labels, _ in found(workers, [t for t, _ in HEADERS])] == [label for _, label in HEADERS]


def test_alternatives_by_hand(workers):
    assert [labels for labels, _ in found(workers, [t for t, _ in BY_HAND])] == [label for _, label in BY_HAND]


def made(tree, pick) -> str:
    """A text that a parsed pattern matches; ``pick`` chooses among alternatives and numbers of repeats."""
    out = ""
    for op, arg in tree:
        if op == sre.LITERAL:
            out += chr(arg)
        elif op == sre.SUBPATTERN:
            out += made(arg[3], pick)
        elif op == sre.BRANCH:
            out += made(arg[1][pick(len(arg[1]))], pick)
        elif op == sre.MAX_REPEAT:
            low, high, inner = arg
            out += "".join(made(inner, pick) for _ in range(low + pick(min(high, low + 1) - low + 1)))
        else:
            assert op == sre.IN, op
            kind, value = arg[pick(len(arg))]
            if kind == sre.CATEGORY:
                out += str(pick(10)) if value == sre.CATEGORY_DIGIT else "z"
            else:
                out += chr(value if kind == sre.LITERAL else value[0] + pick(value[1] - value[0] + 1))
    return out


def test_every_signature_passes_gate_and_prefilter(workers):
    rng = random.Random(5)
    ordered = rules()
    cases = []
    for r in ordered:
        tree = sre.parse(r.pattern)
        texts = {made(tree, rng.randrange) for _ in range(60)}
        # digits joined on and every alternative: the shortest and the longest choice too
        texts |= {made(tree, lambda n: 0), made(tree, lambda n: n - 1)}
        for t in sorted(texts):
            assert re.fullmatch(r.pattern, t)
            words = set(t.split(" "))
            assert all(words & set(group) for group in r.gate), (r, t)
            assert any(f" {k}" in f" {t}" for k in r.keywords), (r, t)
        cases += [(r, t) for t in sorted(texts)[::15]]
    lost = [(r, t) for (r, t), (_, score) in zip(cases, found(workers, [t for _, t in cases]), strict=True)
            if score < min(r.weight, 0.99)]
    assert not lost


def test_words_as_a_pattern_match_nothing_else():
    words = ["gpl", "gplv", "gplv2", "gpl2", "lgpl", "0", "©", "©1999"]
    near = [w + c for w in words for c in "v2 "] + [w[1:] for w in words] + [w[:-1] for w in words]
    for one in (words, words[:1], words[:2]):
        assert [w for w in {*words, *near} if re.fullmatch(licenses.any_of(one), w) and w not in one] == []
        assert all(re.fullmatch(licenses.any_of(one), w) for w in one)


def test_gaps_of_all_kinds(workers):
    texts = ["", " ", "-", " - ", "a", " a", "a ", "\ta\n", "a--b", "a - b", "a  b c", "^gpl^", "İ gpl\r\n\r\nv3 İ",
             "\x00mit\x7f license", "CC-BY\t4.0", "x  all  rights\nreserved."]
    df = workers.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.first_word, r.labels) for r in licenses.scan(df).collect())
    own = {11: "gpl", 12: "gpl-3.0", 13: "mit", 14: "cc-by", 15: "reserved"}
    first = {14: 0, 15: 1}
    assert got == [(i, len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)), first.get(i), own.get(i, ""))
                   for i, t in enumerate(texts)]


def test_rules_take_no_rows_of_the_driver(workers):
    """Such rows start Python workers on every executor, which stay in its memory."""
    df = workers.createDataFrame([(1, "under GPL")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "LogicalRDD" not in plan and "broadcast" not in plan.lower()
