"""Nulls, empty and long texts, ties and repeats, empty tables, clashing columns."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from llm_session import workers  # noqa: F401
from pyspark.sql import functions as F

from crease.llm import decontaminate, hnsw, katz, licenses, packing, quality, simhash, token_counts, tool_calls, warc
from crease.llm.pretokens import load
from crease.llm.queries import tokenizer_path

LONG = "Alpha beta, gamma! " * 30_000
TEXTS = [(1, None), (2, ""), (3, "All Rights Reserved."), (3, "All Rights Reserved."), (None, "one two three four"),
         (4, LONG), (5, "one two three four"), (6, "\n \t"), (7, "日本語 x 😀 a<|endoftext|>b naïve İstanbul"),
         (8, "one"), (9, "CC BY cc by CC-BY; GNU General Public License, version 2")]


def clashing(spark, rows=TEXTS):
    """Documents with extra columns named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ["fp", "row", "component_id", "score", "n_words", "spans", "items", "piece_key", "length", "held_out", "key"]
    return df.withColumns({c: F.lit(7) for c in extra})


def rows(df):
    return [tuple(r) for r in df.collect()]


def order(rs):
    return sorted(rs, key=lambda r: tuple((x is None, x) for x in r))


def test_warc_cases(workers):
    pages = [(1, "u\r\nX: y", "a"), (2, None, None), (3, "v", ""), (4, "v", "a"), (4, "v", "a"), (None, "w", "a"),
             (9, "z", "é" * 300_000)]
    df = workers.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = rows(warc.round_trip(df))
    want = [(1, 1, "response" if False else "revisit", 4), (2, 0, "revisit", 3), (3, 0, "response", None),
            (4, 1, "response", None), (4, 1, "response", None), (None, 1, "revisit", 4), (9, 600_000, "response", None)]
    assert order([(r[0], r[1], r[3], r[4]) for r in got]) == order(want)
    assert rows(warc.round_trip(df.where("page_id < 0"))) == []


def test_warc_small_files_and_payloads(workers):
    df = workers.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url",
                                       "repeat(cast(id as string), 500) as html")
    folder = __import__("crease.llm.common", fromlist=["scratch"]).scratch(workers, "warc-test")
    manifest = warc.write_archives(df, folder, target_bytes=2000)
    assert manifest.count() > 10
    got = warc.read_archives(manifest).where("record_type = 'response'").select("page_id", "target_uri", "payload")
    assert order(rows(got.withColumn("payload", F.col("payload").cast("string")))) == order(rows(df))


def test_token_counts_cases(workers):
    path = tokenizer_path()
    got = rows(token_counts.token_counts(clashing(workers), path, limit=5, cache_rows=3))
    tokenizer = load(path)
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS]
    assert order(got) == order([(i, len((t or "").encode()), k, k > 5) for (i, t), k in zip(TEXTS, n, strict=True)])
    assert rows(token_counts.token_counts(clashing(workers, []), path)) == []


@pytest.mark.parametrize("bucket_rows", [1, 64])
def test_simhash_cases(workers, bucket_rows):
    got = rows(simhash.near_duplicates(clashing(workers), bucket_rows=bucket_rows))
    fps = [brute.fingerprint(t) for _, t in TEXTS]
    of = brute.components(list(range(len(TEXTS))), fps)
    group = {k: [TEXTS[j][0] for j in of if of[j] == of[k] and TEXTS[j][0] is not None] for k in of}
    want = [(i, f"{fps[k]:016x}", min(group[k], default=None)) for k, (i, _) in enumerate(TEXTS)]
    assert order(got) == order(want)
    assert rows(simhash.near_duplicates(clashing(workers, []))) == []


def test_simhash_keeps_one_row_of_each_group(workers):
    df = clashing(workers)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert order(got) == order([(1, None), (3, "All Rights Reserved."), (4, LONG), (5, "one two three four"),
                                TEXTS[8], (8, "one"), TEXTS[10]])


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_match_brute_force(workers, bits):
    rng = np.random.default_rng(bits)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(base)
    for b in base[:12]:  # crowds within few bits of each other
        for _ in range(30):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    want = brute.components(fps, fps, bits)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = workers.createDataFrame([(signed[f],) for f in fps], "fp long")
    for bucket_rows, segments in ((4, 7), (10_000, 5)):
        root = {r.fp: r.root for r in simhash.roots(df, bits, segments, bucket_rows).collect()}
        assert len({(root[signed[f]], want[f]) for f in fps}) == len(set(want.values())) == len(set(root.values()))


def test_decontamination_cases(workers):
    items = [(1, "one two three"), (2, None), (3, "beta gamma alpha beta gamma alpha beta gamma alpha beta gamma"),
             (None, "reserved"), (1, "one two three"), (4, "!!"), (5, "ONE")]
    bench = workers.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    for group_bytes in (1 << 20, 40):
        got = rows(decontaminate.digest(decontaminate.find_hits(clashing(workers), bench, group_bytes=group_bytes)))
        named = brute.decontaminate(TEXTS, [x for x in items if x[0] is not None])
        hit = brute.decontaminate(TEXTS, items)
        want = [(*h[:3], *n[3:5], h[5]) for h, n in zip(hit, named, strict=True)]
        assert order(got) == order(want)
    assert rows(decontaminate.find_hits(clashing(workers, []), bench)) == []
    none = decontaminate.clean(clashing(workers), bench.where("false"))
    assert none.count() == len(TEXTS) and none.columns == clashing(workers).columns


def test_license_cases(workers):
    from crease.llm.license_rules import rules

    text = ("Redistribution and use in source and binary forms, with or without modification, are permitted. "
            "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT. All rights reserved "
            "all rights reserved. CC BY-NC-SA 4.0; the GNU Lesser General Public License version 2.1")
    docs = [*TEXTS, (20, text), (20, text), (21, f"İK {text.upper()}"), (22, "accept ccby reserved")]
    got = rows(licenses.scan(clashing(workers, docs)))
    ordered = rules()
    # the long text has no word of any signature; trying them all on it would only take time
    want = [(i, *brute.phrase_places(t, licenses.PHRASES),
             *(("", 0.0) if t == LONG else brute.licence_labels(t, ordered, licenses.PHRASES))) for i, t in docs]
    assert order(got) == order(want)
    assert rows(licenses.scan(clashing(workers, []))) == []
    own = licenses.scan(clashing(workers, [(1, "a a a b")]), phrases={"a a": "x", "a b": "y"}, ordered=ordered)
    assert rows(own)[0][:6] == (1, 4, 3, 0, 2, "x,y")


def test_hnsw_cases(workers):
    x = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
         (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]),
         (9, [1.0, 2.0, 3.0]), (20, [0.0, 1.0]), (40, [1.0, 0.0, 0.0])]
    df = workers.createDataFrame(x, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = rows(hnsw.search(df, df.where("vec_id % 20 = 0"), k=3, shard_rows=4, query_block=2))
    assert sorted(got) == [(0, 1, 7, 2.0), (0, 2, 8, 2.0), (0, 3, 1, 0.5), (20, 1, 1, 0.5), (20, 2, 0, 0.0),
                           (20, 3, 7, 0.0), (40, 1, 9, 1.0)]
    assert rows(hnsw.search(df.where("vec_id < 0"), df.where("vec_id < 0"))) == []


def test_hnsw_recall_with_norms_and_copies(workers):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) * rng.lognormal(0, 0.7, (3000, 1))
    x[1000:2000] = x[17]  # a third of the rows are one vector
    df = workers.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = rows(hnsw.search(df, df.where("vec_id % 50 = 0"), k=20, shard_rows=1000))
    hits = []
    for q in range(0, 3000, 50):
        want = brute.nearest(range(3000), x, q)
        found = [v for a, _, v, _ in sorted(got) if a == q]
        s = x @ x[q]
        hits.append(np.mean([s[v] >= s[want[-1]] - 1e-9 for v in found]) * (len(set(found)) == 20))
    assert np.mean(hits) >= 0.9


def test_packing_cases(workers):
    path = tokenizer_path()
    got = rows(packing.pack(clashing(workers), path, capacity=64, block_items=8))
    want = [(i, *p) for i, t in TEXTS for p in brute.pieces(t, load(path), 64)]
    assert order(r[:5] for r in got) == order(want)
    brute.check_sequences([(r[5], r[6], r[3]) for r in got], 64)
    assert rows(packing.pack(clashing(workers, []), path)) == []


def test_packing_reaches_the_bound_in_blocks(workers):
    items = workers.range(6000).selectExpr("id as piece_key", "1 + pmod(xxhash64(id), 2047) as length")
    placed = packing.place(items, block_items=1024)
    got = placed.join(items, "piece_key").select("sequence_id", "offset", "length").collect()
    assert len(got) == 6000
    whole = packing.Grouping([r.length for r in got], 2048)  # best fit of all pieces at once
    whole.best_fit(list(range(6000)))
    assert brute.check_sequences(got) <= 1.005 * len(whole.bins)
    wide = workers.range(300).selectExpr("id as piece_key", "1100 as length")  # no two fit: must end
    assert packing.place(wide, block_items=32).select("sequence_id").distinct().count() == 300


def test_katz_cases(workers):
    got = rows(katz.score(clashing(workers), chunk_tokens=1000))
    want = list(brute.Katz(TEXTS).rows())
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert rows(katz.score(clashing(workers, []))) == []
    untrained = next(i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 7 == 2)
    (only,) = rows(katz.score(workers.createDataFrame([(untrained, "a b")], "doc_id long, text string")))
    assert only == (untrained, True, 3, 0, 0, 0.0, 0.0)


def test_quality_cases(workers):
    labels = workers.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (4, 1, 0), (8, 0, 0)],
                                     "doc_id long, quality int, toxic int")
    got = rows(quality.score(clashing(workers), labels))
    assert order((r[0],) for r in got) == order((i,) for i, _ in TEXTS)
    assert all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.3) for r in got)
    assert {r[2] for r in rows(quality.score(clashing(workers), labels.where("false")))} == {0.5}
    assert rows(quality.score(clashing(workers, []), labels)) == []
    kept = quality.keep(clashing(workers), labels.where("false"))
    assert kept.count() == len(TEXTS) and kept.columns == clashing(workers).columns


def test_tool_call_cases(workers):
    calls = [(1, "a", 1, "search", '{"query":"x","limit":3}', None), (1, "b", 3, "search", '{"limit":0,"query":"y"}', "a"),
             (1, "c", 5, "open", '{"page": 2, "z": 1}', "b"), (1, "d", 7, "nope", "{}", None), (1, "e", 9, "open", "{", None),
             (1, "f", 11, "open", None, "missing"), (2, "p", 1, "open", '{"page":1}', "q"),
             (2, "q", 2, "open", '{"page":1}', "p"), (3, "t", 1, "open", '{"page":1}', None),
             (3, "t", 1, "open", '{"page":1}', None), (None, "n", 1, "open", '{"page":NaN}', None)]
    results = [(1, "a", 2, "r"), (1, "b", 4, None), (1, "zz", 6, "r"), (3, "t", 2, "r"), (3, "t", 3, "r"), (2, "p", 2, "r")]
    c = workers.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string")
    r = workers.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    got = {(x.conv_id, x.call_id, x.kind): x for x in tool_calls.link(
        c.withColumn("level", F.lit(1)), r.withColumn("kind", F.lit("k")), tool_calls.SCHEMAS).collect()}
    assert len(got) == 11 - 1 + 6 - 1
    call = {k[1]: (x.level, x.linked, x.error) for k, x in got.items() if k[2] == "call"}
    assert call["a"] == (0, True, None)
    assert call["b"] == (2, True, "$.limit: out of bounds")
    assert call["c"] == (4, False, "$.z: not allowed")
    assert call["d"] == (0, False, "unknown tool") and call["e"] == (0, False, "bad json")
    assert call["f"] == (0, False, "bad json") and call["p"] == (None, True, "cycle") and call["q"][2] == "cycle"
    assert call["t"] == (0, True, "duplicate call") and call["n"] == (None, False, "bad json")
    result = {k[:2]: (x.level, x.linked, x.error) for k, x in got.items() if k[2] == "result"}
    assert result[1, "a"] == (1, True, None) and result[1, "zz"] == (None, False, "missing call")
    assert result[3, "t"] == (1, True, "duplicate result")
    assert got[1, "a", "call"].message == (
        '{"after":null,"role":"assistant","tool_call":{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"}}')
    assert tool_calls.link(c.where("false"), r.where("false"), {}).collect() == []


def test_long_chain_of_calls(workers):
    n = 700
    c = workers.range(n).selectExpr("5 as conv_id", "concat('c', id) as call_id", "id as turn", "'open' as name",
                                    "'{\"page\":1}' as arguments", "if(id > 0, concat('c', id - 1), null) as after")
    r = c.selectExpr("conv_id", "call_id", "turn", "'x' as content")
    got = tool_calls.link(c, r, tool_calls.SCHEMAS).where("kind = 'call'").collect()
    assert sorted((x.turn, x.level) for x in got) == [(i, 2 * i) for i in range(n)]


@pytest.mark.parametrize("capacity, block_items, count, size", [
    (100, 10, 60, 1), (8192, 64, 300, 1), (7, 4, 20, 2), (6, 3, 8, 5)])
def test_packing_ends_on_small_pieces(workers, capacity, block_items, count, size):
    items = workers.range(count).selectExpr("id piece_key", f"cast({size} as long) length")
    got = packing.place(items, capacity, block_items=block_items, epochs=1, generations=2).collect()
    used = brute.check_sequences([(r.sequence_id, r.offset, size) for r in got], capacity)
    assert len(got) == count and used <= 1.3 * -(-count // (capacity // size)) + 1


def test_many_empty_texts_are_packed(workers):
    docs = workers.range(300).selectExpr("id doc_id", "'' text")
    got = packing.pack(docs, tokenizer_path(), capacity=512, block_items=64, epochs=1, generations=1).collect()
    assert brute.check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 512) == 1 and len(got) == 300


def test_hnsw_recall_over_twenty_shards(workers):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16)) + rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)]
    df = workers.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = rows(hnsw.search(df, df.where("vec_id % 40 = 0"), shard_rows=200, query_block=30))
    near = {}
    for q, _, v, _ in got:
        near.setdefault(q, set()).add(v)
    assert len(near) == 100
    hits = [len(near[q] & set(brute.nearest(range(4000), x, q))) / 20 for q in near]
    assert np.mean(hits) >= 0.9 and min(hits) >= 0.6
