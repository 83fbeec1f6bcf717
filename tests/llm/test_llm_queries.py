"""Registered queries over whole small tables against plain versions."""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from llm_session import workers  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(workers):
    return sorted((r.doc_id, r.text) for r in workers.read.parquet(f"{D}/documents.parquet").collect())


def run(spark, name):
    from crease.llm.queries import llm_queries

    return [tuple(r) for r in llm_queries()[name](spark, D).collect()]


def test_warc(workers):
    pages = [(r.page_id, r.html) for r in workers.read.parquet(f"{D}/pages.parquet").collect()]
    assert sorted(run(workers, "op1_warc")) == sorted(brute.warc(pages))


def test_token_counts(workers, docs):
    from crease.llm.pretokens import load
    from crease.llm.queries import tokenizer_path

    tokenizer = load(tokenizer_path())
    want = [(i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 1024)
            for i, t in docs]
    assert sorted(run(workers, "op2_token_counts")) == want


def test_simhash(workers, docs):
    fps = [brute.fingerprint(t) for _, t in docs]
    of = brute.components([i for i, _ in docs], fps)
    assert sorted(run(workers, "op3_simhash")) == [(i, f"{f:016x}", of[i]) for (i, _), f in zip(docs, fps, strict=True)]
    assert any(c != i for i, c in of.items())


def test_decontamination(workers, docs):
    items = [(r.item_id, r.text) for r in workers.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = brute.decontaminate(docs, items)
    assert sorted(run(workers, "op4_decontamination")) == want
    assert any(r[-1] for r in want)


def test_licenses(workers, docs):
    from crease.llm.license_rules import rules
    from crease.llm.licenses import PHRASES

    ordered = rules()
    want = [(i, *brute.phrase_places(t, PHRASES), *brute.licence_labels(t, ordered, PHRASES)) for i, t in docs]
    assert sorted(run(workers, "op5_licenses"), key=lambda r: r[0]) == want
    assert any(r[5] for r in want)


def test_hnsw_recall(workers):
    rows = sorted((r.vec_id, r.embedding) for r in workers.read.parquet(f"{D}/embeddings.parquet").collect())
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    got = defaultdict(list)
    for q, rank, v, s in sorted(run(workers, "op6_hnsw")):
        got[q].append(v)
        assert rank == len(got[q])
        assert s == pytest.approx(float(x[ids.index(q)] @ x[ids.index(v)]), abs=1e-12)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    hits = [len(set(found) & set(brute.nearest(ids, x, q))) / 20 for q, found in got.items()]
    assert np.mean(hits) >= 0.9


def test_packing(workers, docs):
    from crease.llm.pretokens import load
    from crease.llm.queries import tokenizer_path

    tokenizer = load(tokenizer_path())
    rows = run(workers, "op7_packing")
    want = [(i, *p) for i, t in docs for p in brute.pieces(t, tokenizer)]
    assert sorted(r[:5] for r in rows) == want
    used = brute.check_sequences([(r[5], r[6], r[3]) for r in rows])
    least = -(-sum(r[3] for r in rows) // 2048)
    assert least <= used <= least + 1


def test_tool_calls(workers):
    rows = run(workers, "op8_tool_calls")
    told = [tuple(r) for r in workers.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role",
                                                                                       "text").collect()]
    calls = {(c, t): x for c, t, role, x in told if role == "assistant"}
    results = {(c, t - 1) for c, t, role, _ in told if role == "user" and t > 0}
    assert Counter(r[2] for r in rows) == {"call": len(calls), "result": len(results),
                                           "message": len(told) - len(calls) - len(results)}
    held = {}
    for conv, _, kind, turn, *_, message in rows:
        m = json.loads(message)
        given = m["tool_call"]["arguments"] if kind == "call" else None
        held[conv, turn] = (given.get("query", given.get("text")) if given else m["content"])
    assert held == {(c, t): x or "" for c, t, _, x in told}  # every row's whole text
    for conv, call, kind, turn, level, linked, error, _ in rows:
        if kind == "message":
            assert (call, level, linked, error) == (None, None, False, None)
            continue
        at = (conv, int(call.split("-")[1]))
        assert linked == (at in (results if kind == "call" else calls))
        if kind == "call":
            depth = 0
            while (at[0], at[1] - 2) in calls:
                depth, at = depth + 1, (at[0], at[1] - 2)
            assert level == 2 * depth
            if error is None:
                assert linked and turn == int(call.split("-")[1])


def test_katz(workers, docs):
    model = brute.Katz(docs)
    got = {r[0]: r for r in run(workers, "op9_katz")}
    assert len(got) == len(docs)
    for want in model.rows():
        assert got[want[0]][:5] == want[:5]
        assert got[want[0]][5:] == pytest.approx(want[5:], rel=1e-9)
    for v in [("begin",), "the", next(w for (_, w), c in model.bi.items() if c == 1 and w)]:
        assert sum(model.p(w, v) for w in [*model.uni, "\0 unknown"]) == pytest.approx(1)


def test_quality_held_out(workers):
    label = {r.doc_id: r.quality for r in workers.read.parquet(f"{D}/labels.parquet").collect()}
    rows = run(workers, "op10_quality")
    assert len(rows) == 200
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, h, s, p in rows)
    held = [(p, label[i]) for i, h, _, p in rows if h and i in label]
    assert np.mean([p == y for p, y in held]) >= 0.9


def test_pipeline_matches_a_plain_one(workers, docs):
    import corpus_pipeline
    from crease.llm import quality
    from crease.llm.pretokens import load
    from crease.llm.queries import tokenizer_path

    table = workers.read.parquet(f"{D}/documents.parquet")
    labels = workers.read.parquet(f"{D}/labels.parquet")
    ranker = quality.fit(table, labels)
    scores = ranker.scores([quality.features(t) for _, t in docs])
    kept = [d for d, s in zip(docs, scores, strict=True) if s >= 0.3]
    fps = [brute.fingerprint(t) for _, t in kept]
    of = brute.components([i for i, _ in kept], fps)
    kept = [d for d in kept if of[d[0]] == d[0]]
    items = [(r.item_id, r.text) for r in workers.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.decontaminate(kept, items) if r[-1]}
    kept = [d for d in kept if d[0] not in bad]
    rows = [tuple(r) for r in corpus_pipeline.run(workers, D).collect()]
    tokenizer = load(tokenizer_path())
    assert sorted(r[:5] for r in rows) == [(i, *p) for i, t in kept for p in brute.pieces(t, tokenizer)]
    brute.check_sequences([(r[5], r[6], r[3]) for r in rows])


def test_stages_keep_the_columns(workers):
    import corpus_pipeline

    docs = workers.read.parquet(f"{D}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(workers, docs, D)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
