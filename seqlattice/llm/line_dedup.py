"""Line dedup: hashes go into ranges, each range is streamed in the order of hash, document and position.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  Keys of at
least ``min_chars`` code points that at least ``min_docs`` documents hold keep their lines in the document of the
largest id only.  The result is a compressed keep bitmap for each document that loses lines, never text.

Hot keys: the ranges are cut by (hash, document), so one key may lie in several of them.  A range settles every key
that begins and ends inside it; of its first and last key it returns the rows and one summary row each, at most two
for each range, and these are put together afterwards.

Defined cases: a null text counts as empty (one empty line).  Rows of one document id count as one document; a null
id is a document smaller than all others.  Rows that repeat wholly get the same result each.  An empty table gives no
rows.  Columns of any name pass through; one named ``__lines`` gives way to the result.  A text of any length is hashed
whole, in one task; its lines are then rows of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, materialize, record_batch, released, text_bytes

#: Stands for a null id: smaller than every id in use.
NO_ID = -(1 << 63)
_LINES = "h1 long, h2 long, doc long, tx long, pos int"
_LINES_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tx", pa.int64()), ("pos", pa.int32())])
_DROP, _OPEN, _SUM = 0, 1, 2
_SETTLED = "kind int, h1 long, h2 long, doc long, tx long, pos int"
_SETTLED_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tx", pa.int64()), ("pos", pa.int32())])


def line_key(line: bytes) -> bytes:
    return line.strip().translate(LOWER)


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= chars)


@released
def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        docs, texts, raws = (batch.column(i) for i in range(3))
        keys, lines_at, counts = [], [], []
        for raw in raws.to_pylist():
            n = len(keys)
            for pos, line in enumerate(raw.split(b"\n")):
                if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                    keys.append(digest(key))
                    lines_at.append(pos)
            counts.append(len(keys) - n)
        hashes = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield record_batch(_LINES_ARROW, np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1]), np.repeat(docs.to_numpy(), counts), np.repeat(texts.to_numpy(), counts), np.array(lines_at, np.int32))


def _rows(kind: int, part: np.ndarray) -> pa.RecordBatch:
    return record_batch(_SETTLED_ARROW, np.full(part.shape[1], kind, np.int32), part[0], part[1], part[2], part[3], part[4].astype(np.int32))


@released
def _settle(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Stream one range, sorted by hash, document (largest first) and position.

    Held back between batches are only rows of the key that the batch ends in: all of them while fewer than
    ``min_docs`` documents are seen, else one row for each of its first documents.
    """
    held = np.empty((6, 0), np.int64)  # h1, h2, doc, tx, pos, already returned
    first, first_docs, first_top, last_doc = None, 0, 0, None

    for batch in batches:
        now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)] + [np.zeros(batch.num_rows, np.int64)])
        if not now.shape[1]:
            continue
        if first is None:
            first, first_top = (now[0, 0], now[1, 0]), now[2, 0]
        if held.shape[1] == 0 and first_docs >= 0:  # still in the first key, whose start may lie in another range
            same = (now[0] == first[0]) & (now[1] == first[1])
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                docs = now[2, :n]
                first_docs += int((docs[1:] != docs[:-1]).sum()) + (last_doc is None or last_doc != docs[0])
                last_doc = docs[-1]
                yield _rows(_OPEN, now[:, :n])
                now = now[:, n:]
            if not now.shape[1]:
                continue
            yield _rows(_SUM, np.array([[first[0]], [first[1]], [first_top], [0], [first_docs]]))
            first_docs = -1
        rows = np.concatenate([held, now], axis=1)
        new_key = np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
        new_doc = new_key | np.append(True, rows[2, 1:] != rows[2, :-1])
        run = np.cumsum(new_key) - 1
        starts = np.flatnonzero(new_key)
        n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        drop = (n_docs[run] >= min_docs) & (rows[2] != rows[2, starts][run]) & (rows[5] == 0)
        if drop.any():
            yield _rows(_DROP, rows[:, drop])
        rows[5, drop] = 1
        held, docs_seen = rows[:, starts[-1]:], np.cumsum(new_doc[starts[-1]:])
        if docs_seen[-1] >= min_docs:
            held = held[:, new_doc[starts[-1]:] & (docs_seen <= min_docs)]
    if first is not None and first_docs >= 0:
        yield _rows(_SUM, np.array([[first[0]], [first[1]], [first_top], [0], [first_docs]]))
    elif held.shape[1]:
        docs = held[2]
        yield _rows(_OPEN, held[:, held[5] == 0])
        yield _rows(_SUM, np.array([[held[0, 0]], [held[1, 0]], [docs[0]], [0], [1 + int((docs[1:] != docs[:-1]).sum())]]))


def pack_bitmap(dropped: list[int] | np.ndarray) -> bytes:
    """Keep bits up to the last line that goes, compressed; every later line stays."""
    at = np.asarray(dropped, np.int64)
    keep = np.ones((int(at.max()) // 8 + 1) * 8 if len(at) else 0, bool)  # whole bytes
    keep[at] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    if bitmap is None:
        return np.ones(n_lines, bool)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines].astype(bool)
    return np.append(keep, np.ones(n_lines - len(keep), bool))


@F.pandas_udf(T.BinaryType())
def _pack(dropped: pd.Series) -> pd.Series:
    return dropped.map(pack_bitmap)


def _identity(id_col: Column, text_col: Column) -> list[Column]:
    return [F.coalesce(id_col.cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("tx")]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Keep bitmaps (doc, tx, bitmap, n_dropped) of the documents that lose lines; ``doc`` and ``tx`` name a document's text."""
    text = F.col(text_col)
    lines = materialize(docs.select(*_identity(F.col(id_col), text), text_bytes(text).alias("raw")).mapInArrow(partial(_hash_lines, min_chars=min_chars), _LINES), "lines")
    ranges = lines.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.desc("doc"), "tx", "pos")
    settled = materialize(ranges.mapInArrow(partial(_settle, min_docs=min_docs), _SETTLED), "settled")
    over = (
        settled.filter(F.col("kind") == _SUM).groupBy("h1", "h2").agg(F.sum("pos").alias("n"), F.max("doc").alias("top"))
        .filter(F.col("n") >= min_docs).select("h1", "h2", "top")
    )  # at most two rows for each range
    left = settled.filter(F.col("kind") == _OPEN).join(F.broadcast(over), ["h1", "h2"]).filter(F.col("doc") != F.col("top"))
    drops = settled.filter(F.col("kind") == _DROP).select("doc", "tx", "pos").unionByName(left.select("doc", "tx", "pos"))
    return drops.groupBy("doc", "tx").agg(F.collect_set("pos").alias("at")).select("doc", "tx", _pack("at").alias("bitmap"), F.size("at").cast("long").alias("n_dropped"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType())]))
def _kept_lines(raw: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
    texts, counts = [], []
    for text, bits in zip(raw, bitmap, strict=True):
        if bits is None:
            texts.append(text.decode("utf-8", "replace"))
            counts.append(text.count(b"\n") + 1)
            continue
        lines = text.split(b"\n")
        keep = unpack_bitmap(bits, len(lines))
        texts.append(b"\n".join([x for x, k in zip(lines, keep, strict=True) if k]).decode("utf-8", "replace"))
        counts.append(len(lines))
    return pd.DataFrame({"text": texts, "n_lines": counts})


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__lines`` of the kept text, the lines before and the lines dropped."""
    row = F.struct(*(F.col(c) for c in docs.columns if c != "__lines")).alias("row")
    keyed = docs.select(row, *_identity(F.col(id_col), F.col(text_col)))
    joined = keyed.join(bitmaps, ["doc", "tx"], "left").withColumn("kept", _kept_lines(text_bytes(F.col("row")[text_col]), F.col("bitmap")))
    return joined.select("row.*", F.struct("kept.text", "kept.n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped")).alias("__lines"))
