"""Token counts with the whole-token shortcut.

The vocabulary strings that encode alone as one token are proven once, on the
driver, and broadcast (bounded by the vocabulary).  A task cuts texts into
pre-tokens: those in the proven set count one each without merging, only the
rest go through the tokenizer's merges, and each distinct one only once while
it stays in the task's cache, which holds ``cache_rows`` pre-tokens of at most
``LONG_PIECE`` characters (a speed-up of bounded memory; the counts do not
depend on it).  No shuffle.

Defined cases: null text is empty and has no tokens; special strings inside a
text are one token each, as the tokenizer's default has it; repeated rows are
returned as often as given; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.pretokens import (LONG_PIECE, around_special, fast_encoding, pre_tokens, prove_whole_tokens,
                                  special_strings)


class Counts(dict):
    """Tokens of a pre-token: 1 for proven ones, merged on first sight for others."""

    def __init__(self, whole: list[str], path: str, cache_rows: int):
        super().__init__(dict.fromkeys(whole, 1))
        self.encoding, self.limit = fast_encoding(path), len(whole) + cache_rows
        self.whole, self.path = whole, path

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) > LONG_PIECE:
            return n
        if len(self) >= self.limit:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n


def count(text: str | None, counts: Counts, special: list[str]) -> int:
    parts = around_special(text or "", special)
    return len(parts) - 1 + sum(sum(map(counts.__getitem__, pre_tokens(p, counts.path))) for p in parts)


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = 1024, cache_rows: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(tokenizer_path))

    def run(batches):
        counts, special = Counts(whole.value, tokenizer_path, cache_rows), special_strings(tokenizer_path)
        for b in batches:
            n = [count(t.as_py(), counts, special) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
