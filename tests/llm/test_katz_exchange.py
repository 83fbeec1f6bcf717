"""What Katz's steps hand on to each other, and how long its files stay."""

import os

import numpy as np
import pytest
from llm_session import workers  # noqa: F401
from pyspark.sql import functions as F

from crease.llm import katz


@pytest.mark.parametrize("d", [[1.0], [1.0, 0.4], [1.0, 0.3, 0.6, 0.7, 0.8, 0.85]])
def test_tallies_give_the_discounted_sums(d):
    rng = np.random.default_rng(len(d))
    place, counts = rng.integers(0, 40, 3000), rng.zipf(1.3, 3000).clip(max=1 << 40)
    many, rest = katz._tally(place, counts, 50, d)
    assert np.allclose(katz._tallied(many, rest, d), np.bincount(place, katz.discounted(counts, d), 50), rtol=1e-12)


def test_words_get_their_number_and_count():
    words = [b"b", b"a", b"c"]
    asked = katz._frame([(k, 1, "ask", katz.zlib.compress(b"".join(words)), katz._pack([1, 1, 1], "<i4"),
                          katz._pack([1, 5, 1 << 30], "<i4"), katz._pack([2, 0, 1], "<i4")) for k in range(3)])
    told = katz._by_kind(katz._count_words(4)((1,), asked))
    number, count = katz._numbers(told["word"][:1], 4)
    assert count.tolist() == [15, 3 << 30, 3] and number.tolist() == [5, 1, 9]


def test_context_requests_are_small_and_files_that_nothing_reads_go(workers, monkeypatch):  # noqa: F811
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 200) % 5000) for _ in range(400)]
    docs = workers.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folders, keep = {}, katz.stage

    def staged(df, name, **options):
        out = keep(df, name, **options)
        folders[name] = out[1]
        return out

    monkeypatch.setattr(katz, "stage", staged)
    got = katz.score(docs, chunk_tokens=20_000, bucket_pairs=10_000)
    left = {name for name, path in folders.items() if os.path.exists(path.removeprefix("file:"))}
    assert left == {"katz-partial", "katz-contexts"}
    assert got.where("score < 0").count() == 400
    size = sum(F.coalesce(F.length(c), F.lit(0)) for c in "abcd")
    rows = workers.read.parquet(folders["katz-partial"]).where("kind = 'ask'").select("a", size.alias("n")).collect()
    assert sum(r.n for r in rows) < 13 * sum(len(katz._unpack_sorted(r.a)) for r in rows)
