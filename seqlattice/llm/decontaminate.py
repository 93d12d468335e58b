"""Benchmark decontamination: suffix arrays of the training texts, and every suffix of the test items searched in them.

Words are runs of the bytes 0-9, a-z and above 0x7F after A-Z are lower-cased.  A window is ``size`` consecutive words
of an item; an item of fewer words, but not none, is one window.  Each task makes suffix arrays over shards of its
documents: of every suffix that begins with as many words that the items use as the shortest window has, in the order of
its first ``size`` words, as no more decide on a window.  Every item suffix is found in the array by binary search: the
range that shares its window, and so the places.  Windows that follow each other at one distance between item and
document are one match, which is the longest there.

The items are cut into blocks of about ``block_words`` words, whose suffixes are made once and broadcast; one map step
goes through ``STEP_BLOCKS`` blocks, which bounds what a worker holds, and a larger benchmark takes further steps.
Documents are never shuffled.

Defined cases: null and empty texts have no words.  Repeated rows and items are handled each by itself; an item without
an id counts as a hit but is named nowhere.  Empty tables give no rows or no hits.  Columns of any name pass through; the
results are ``__n_words``, ``__n_hit`` and ``__matches``.  A text of any length is one shard, whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, released, text_bytes

_SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 10
#: Words of a benchmark block, and bytes of text in a shard.
BLOCK_WORDS, SHARD_BYTES = 200_000, 4_000_000
STEP_BLOCKS = 8

_MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"
_MATCH_ARROW = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_SEPARATE).split()


class Items:
    """The suffixes of a block of items, by the numbers of their first ``size`` words; 0 is any other word."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = WINDOW):
        texts = [(i, w) for i, w in ((i, words_of(raw)) for i, raw in items) if w]
        self.size = size
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for _, ws in texts for w in ws), 1)}
        self.names = [i for i, _ in texts]
        self.least = min((min(len(w), size) for _, w in texts), default=size)
        self.kind = np.dtype(">u2" if len(self.vocabulary) + 1 < 1 << 16 else ">u4")
        suffixes = [(n, at, min(len(ws), size)) for n, (_, ws) in enumerate(texts) for at in range(max(1, len(ws) - size + 1))]
        self.item, self.start, self.window = np.array(suffixes, np.int64).reshape(-1, 3).T.copy()
        rows = [self._first([self.vocabulary[w] for w in ws]) for _, ws in texts]
        rows = np.concatenate(rows) if rows else np.empty((0, size), self.kind)
        beyond = np.arange(size) >= self.window[:, None]
        self.low, self.high = self._keys(rows), self._keys(np.where(beyond, np.iinfo(self.kind).max, rows))

    def _first(self, ids: list[int]) -> np.ndarray:
        """The first words of each suffix of an item that is as long as a window."""
        padded = np.array(ids + [0] * (self.size - len(ids)), self.kind)
        return np.lib.stride_tricks.sliding_window_view(padded, self.size)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows, self.kind).view(f"S{self.size * self.kind.itemsize}").ravel()

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item suffix, place in ids) of each suffix of ``ids`` that begins with an item's window."""
        ends = np.where(ids > 0, len(ids), np.arange(len(ids)))
        run = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(ids))  # known words from here on
        at = np.flatnonzero(run >= self.least)
        if not len(at) or not len(self.item):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.append(ids, np.zeros(self.size, ids.dtype))
        rows = np.lib.stride_tricks.sliding_window_view(padded, self.size)[at].astype(self.kind)
        rows[np.arange(self.size) >= run[at][:, None]] = 0
        order = np.lexsort(rows.T[::-1].astype(np.uint16 if self.kind.itemsize == 2 else np.uint32))
        array, at = self._keys(rows)[order], at[order]
        first, last = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        n = last - first
        which = np.repeat(np.arange(len(n)), n)
        return which, at[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]

    def search(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, list[dict]]]:
        """Of each document of a shard: its hit words, and the matches that no longer one holds."""
        get = self.vocabulary.get
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        ids = np.zeros(int((lengths + 1).sum()), np.uint32)
        for begin, words in zip(begins.tolist(), texts, strict=True):
            ids[begin : begin + len(words)] = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        which, place = self.find(ids)
        out: list[tuple[np.ndarray, list[dict]]] = [(np.empty(0, np.int64), []) for _ in texts]
        if not len(which):
            return out
        doc = np.searchsorted(begins, place, side="right") - 1
        inner = place - begins[doc]
        order = np.lexsort((inner, inner - self.start[which], self.item[which], doc))
        which, doc, inner = which[order], doc[order], inner[order]
        along = np.stack([doc, self.item[which], inner - self.start[which]])
        new = np.append(True, (along[:, 1:] != along[:, :-1]).any(axis=0) | (np.diff(inner) != 1))
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
        length = inner[last] + self.window[which[last]] - inner[first]
        which, doc, inner = which[first], doc[first], inner[first]
        for d, lo, hi in zip(*_runs(doc), strict=True):
            marks = np.zeros(lengths[d] + 1, np.int32)
            np.add.at(marks, inner[lo:hi], 1)
            np.subtract.at(marks, inner[lo:hi] + length[lo:hi], 1)
            found = [{"item_id": self.names[self.item[w]], "item_start": int(self.start[w]), "doc_start": int(p), "n_words": int(n)} for w, p, n in zip(which[lo:hi], inner[lo:hi], length[lo:hi], strict=True)]
            out[d] = (np.flatnonzero(np.cumsum(marks)[:-1] > 0), found)
        return out


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts].tolist(), starts.tolist(), np.append(starts[1:], len(values)).tolist()


@released
def _search(batches: Iterator[pa.RecordBatch], schema: pa.Schema, blocks: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    names = schema.names
    for batch in batches:
        columns = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        raws = columns["raw"].to_pylist()
        n_words: list[int] = []
        hits = columns["hits"].to_pylist() if "hits" in columns else [[] for _ in raws]
        matches = columns["matches"].to_pylist() if "matches" in columns else [[] for _ in raws]
        at = 0
        while at < len(raws):
            end, room = at, SHARD_BYTES
            while end < len(raws) and (end == at or len(raws[end]) <= room):
                room -= len(raws[end])
                end += 1
            texts = [words_of(raw) for raw in raws[at:end]]
            n_words += map(len, texts)
            for block in blocks:
                for k, (hit, found) in enumerate(block.value.search(texts), at):
                    if found:
                        hits[k] = sorted({*hits[k], *hit.tolist()})
                        matches[k] += found
            at = end
        made = {"n_words": n_words, "hits": hits, "matches": matches, "n_hit": [len(h) for h in hits]}
        yield record_batch(schema, *(made.get(k, columns.get(k)) for k in names))


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of about ``block_words`` words, read once; a long item is a block by itself."""
    held, room = [], 6 * block_words
    for r in benchmark.select(F.col(item_col).cast("string").alias("item"), text_bytes(F.col(text_col)).alias("raw")).toLocalIterator():
        if held and len(r.raw) > room:
            yield Items(held, size)
            held, room = [], 6 * block_words
        held.append((r.item, bytes(r.raw)))
        room -= len(r.raw)
    yield Items(held, size)


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: dict | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """n_words, n_hit and the longest verbatim matches of every row, beside the columns ``keep`` (all of ``docs`` by default)."""
    context = docs.sparkSession.sparkContext
    keep = keep or {c: F.col(c) for c in docs.columns}
    row = F.struct(*(c.alias(k) for k, c in keep.items()))
    step = docs.select(row.alias("row"), text_bytes(F.col(text_col)).alias("raw"))
    blocks = [context.broadcast(b) for b in blocks_of(benchmark, item_col, item_text_col, size, block_words)]
    kind = step.schema["row"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    for k in range(0, len(blocks), STEP_BLOCKS):
        last = k + STEP_BLOCKS >= len(blocks)
        fields = [("row", to_arrow_type(step.schema["row"].dataType), kind), *([] if last else [("raw", pa.binary(), "binary"), ("hits", pa.list_(pa.int32()), "array<int>")]), ("n_words", pa.int64(), "long"), ("n_hit", pa.int64(), "long"), ("matches", pa.list_(_MATCH_ARROW), _MATCH)]
        schema = pa.schema([(a, b) for a, b, _ in fields])
        step = step.mapInArrow(partial(_search, schema=schema, blocks=blocks[k : k + STEP_BLOCKS]), ", ".join(f"{a} {c}" for a, _, c in fields))
    return step.select("row.*", F.col("n_words").alias("__n_words"), F.col("n_hit").alias("__n_hit"), F.col("matches").alias("__matches"))
