"""Token counts: lengths of frequent pre-tokens from a broadcast table, all others from each worker's own cache.

The vocabulary drops white space and no token crosses it, so a text has as many tokens as its pieces between ASCII
white space have together.  First tier: each task sums up its pieces to a bounded table of its most frequent ones;
these meet in one small aggregation, and the most frequent of all are encoded once and broadcast (``FREQUENT`` rows at
most).  Second tier: what is not in the table is encoded by the library and kept in the worker.  No pre-token is
shuffled beyond those bounded tables, and neither tier changes a count.

Defined cases: a null text counts as empty (no tokens).  The vocabulary's special strings inside a text are what the
library makes of them by default: one token each.  Repeated rows are counted each by itself; an empty table gives no rows.
Of equally frequent pieces any may be in the table.  Only the id and text columns are read, so other columns can't clash.
A text of any length is counted whole, in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, text_bytes, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
#: Pieces of the broadcast table, and of each task's own summary.
FREQUENT, LOCAL = 32_768, 8_192
#: A task's summary is cut to its larger half when it grows beyond this; a piece longer than that many bytes isn't kept.
SUMMARY, LONGEST = 400_000, 48
CACHE_PIECES = 400_000

_FREQ = pa.schema([("piece", pa.binary()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            seen.update(raw.split())
            if len(seen) > SUMMARY:
                seen = Counter(dict(seen.most_common(SUMMARY // 4)))
    top = [(k, n) for k, n in seen.most_common(LOCAL) if len(k) <= LONGEST]
    yield record_batch(_FREQ, [k for k, _ in top], [n for _, n in top])


class PieceLengths(dict):
    """piece -> number of tokens; begins as the frequent table, grows by what the library says, bounded."""

    def __init__(self, frequent: dict[bytes, int], vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.frequent = frequent
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()

    def __missing__(self, piece: bytes) -> int:
        n = len(self.library.encode(piece.decode("utf-8", "replace"), add_special_tokens=False))
        if len(piece) <= LONGEST:
            if len(self) >= CACHE_PIECES:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def _count(batches: Iterator[pa.RecordBatch], frequent: Broadcast, vocabulary: str) -> Iterator[pa.RecordBatch]:
    lengths = PieceLengths(frequent.value, vocabulary)
    look_up = lengths.__getitem__
    for batch in batches:
        raws = batch.column(1).to_pylist()
        yield record_batch(_OUT, batch.column(0), [len(raw) for raw in raws], [sum(map(look_up, raw.split())) for raw in raws])


def frequent_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text", size: int = FREQUENT) -> dict[bytes, int]:
    """Token numbers of the most frequent pieces of all documents: at most ``size`` entries."""
    parts = docs.select(text_bytes(F.col(text_col)).alias("raw")).mapInArrow(_frequent, "piece binary, n long")
    top = parts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    lengths = PieceLengths({}, vocabulary)
    return {piece: lengths[piece] for piece in (bytes(r.piece) for r in top.collect())}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, vocabulary_dir: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    vocabulary = tokenizer_path(VOCABULARY, vocabulary_dir)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("raw"))
    counted = rows.mapInArrow(partial(_count, frequent=shared, vocabulary=vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
