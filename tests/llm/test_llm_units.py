"""Parts of the operators that need no Spark."""

from __future__ import annotations

import io
import json
import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crease.llm import decontaminate, katz, packing, pretokens, simhash, tool_calls, warc
from crease.llm.queries import tokenizer_path


def archive(*payloads):
    return b"".join(warc.page_record(k, "http://x/", p, warc._b32(__import__("hashlib").sha1(p).digest()), None,
                                     "1970-01-01T00:00:00Z", 6) for k, p in enumerate(payloads))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.binary(max_size=5000), max_size=5), st.integers(1, 300))
def test_archives_round_trip_in_small_pieces(payloads, piece):
    got = list(warc.read_archive(io.BytesIO(archive(*payloads)), piece))
    assert [(r["page_id"], r["payload"], r["error"]) for r in got] == [(k, p, None) for k, p in enumerate(payloads)]


def test_damage_is_found():
    good = archive(b"first", b"second")
    assert [r["error"] for r in warc.read_archive(io.BytesIO(good[:-5]))][-1] == "file ends inside a gzip member"
    first = archive(b"first")
    body = zlib.decompress(first, 31)

    def again(x):
        return __import__("gzip").compress(x) + archive(b"next")

    for bad, error in ((body.replace(b"\r\n\r\nfirst", b"\r\n\r\nfjrst"), "block digest mismatch"),
                       (body[:-4], "record does not end after its Content-Length"),
                       (body.replace(b"WARC/1.1", b"X"), "no WARC version line"),
                       (body[:-20], "block shorter than its Content-Length")):
        got = list(warc.read_archive(io.BytesIO(again(bad))))
        assert [r["error"] for r in got] == [error, None]
    noise = bytearray(good)
    noise[30] ^= 0xFF
    assert list(warc.read_archive(io.BytesIO(bytes(noise))))[0]["error"]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), min_size=1, max_size=8),
       st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 5))
def test_wu_manber_finds_what_brute_force_finds(items, doc, window):
    named = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    tables = decontaminate.matchers(named, window)
    got = sorted((s, t.length, i) for t in tables for s, ids in t.search([w.encode() for w in doc]) for i in ids)
    want = set()
    for k, x in enumerate(items):
        n = min(window, len(x))
        for a in range(len(x) - n + 1):
            want |= {(s, n, str(k)) for s in range(len(doc) - n + 1) if doc[s:s + n] == x[a:a + n]}
    assert got == sorted(want)


@settings(deadline=None, max_examples=300)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3), st.integers(3, 16), st.integers(0, 2))
def test_every_link_has_a_viable_chain(x, flips, segments, bits):
    y = x
    for k in flips:
        y ^= 1 << k
    masks, budgets = simhash.ring(bits, segments)
    viable = any(all(((x ^ y) & m).bit_count() <= b for m, b in zip(row, budgets, strict=True)) for row in masks)
    assert viable == ((x ^ y).bit_count() <= bits)


def test_fingerprint_blocks_do_not_matter(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "B", "c", "dd"], k=500))
    want = brute.fingerprint(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 7)
    assert simhash.fingerprint(text) == want


@settings(deadline=None, max_examples=60)
@given(st.text(max_size=80))
def test_ids_and_counts_are_the_tokenizers(text):
    from crease.llm import token_counts

    path = tokenizer_path()
    want = pretokens.load(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pretokens.encode_bytes(text, pretokens.PieceIds(path)), "<u4").tolist() == want
    assert token_counts.count(text, token_counts.Counts([], path, 10), pretokens.special_strings(path)) == len(want)


def test_whole_tokens_are_proven():
    path = tokenizer_path()
    whole = pretokens.prove_whole_tokens(path)
    assert len(whole) > 40_000 and "<|endoftext|>" not in whole
    sample = random.Random(0).sample(whole, 500)
    assert all(len(e.ids) == 1 for e in pretokens.load(path).encode_batch(sample, add_special_tokens=False))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.integers(0, 1000))
def test_crossover_keeps_every_item_once(sizes, seed):
    rng = random.Random(seed)
    parents = []
    for _ in range(2):
        g, order = packing.Grouping(sizes, 100), list(range(len(sizes)))
        rng.shuffle(order)
        for i in order:
            g.best_fit([i])
        parents.append(g)
    child = packing.cross(*parents, rng)
    assert sorted(i for items in child.bins.values() for i in items) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in items) <= 100 for items in child.bins.values())
    assert all(child.room[k] == 100 - sum(sizes[i] for i in items) for k, items in child.bins.items())
    best = packing.evolve(sizes, 100, [], 10, 4, seed)
    assert len(set(best[0])) <= min(len(p.bins) for p in [packing.from_labels(x, sizes, 100) for x in best])


def test_evolution_beats_or_meets_best_fit():
    rng = random.Random(5)
    for _ in range(3):
        sizes = [rng.choice([26, 27, 34, 35, 39, 40, 51]) for _ in range(120)]
        start = packing.Grouping(sizes, 100)
        start.best_fit(list(range(len(sizes))))
        best = packing.evolve(sizes, 100, [], 150, 8, 1)
        assert len(set(best[0])) <= len(start.bins)


def test_discounts():
    d = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})
    assert len(d) == 6 and all(0 < x < 1 for x in d[1:])
    assert katz.discounts({1: 5}) == [1.0] and katz.discounts({}) == [1.0]
    assert (katz.discounted([1, 2, 7], [1.0]) == [0.5, 1.5, 6.5]).all()


@given(st.lists(st.integers(0, 2**63), max_size=50))
def test_packed_arrays(values):
    keys = np.sort(np.array(values, np.uint64))
    assert (katz._unpack_sorted(katz._pack_sorted(keys)) == keys).all()
    assert (katz._unpack(katz._pack(keys, "<u8"), "<u8") == keys).all()


@pytest.mark.parametrize("value, schema, want", [
    (1.0, {"type": "integer"}, None), (True, {"type": "integer"}, "$: not integer"), (1.5, {"type": "number"}, None),
    ("a", {"enum": ["b"]}, "$: not in enum"), ([1, "x"], {"type": "array", "items": {"type": "number"}}, "$[1]: not number"),
    ({"a": {"b": 1}}, {"type": "object", "properties": {"a": {"required": ["c"]}}}, "$.a.c: missing"),
    ("abc", {"type": "string", "maxLength": 2}, "$: bad length"), (None, {"type": "null"}, None)])
def test_schema_faults(value, schema, want):
    assert tool_calls.fault(value, schema) == want


def test_canonical_json():
    assert tool_calls.canonical({"b": [1, {"d": None, "c": "é\n"}], "a": 0.5}) == '{"a":0.5,"b":[1,{"c":"é\\n","d":null}]}'


@pytest.mark.parametrize("body", ['{"limit":1e400,"query":"x"}', "[" * 100_000, '{"query":"\\ud800","limit":1}', "{",
                                  None, '{"limit":NaN}', "9" * 5000])
def test_arguments_that_json_cannot_carry_are_bad_json(body):
    error, message = tool_calls.call_message({"after": None, "call_id": "c", "name": "search", "body": body},
                                             tool_calls.SCHEMAS)
    assert error == "bad json"
    assert json.loads(message)["tool_call"]["arguments"] == body
