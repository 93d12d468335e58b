"""Document fingerprints: sums of wide vectors hashed from paragraphs, modulo 2 ** 32.

A paragraph is a line that isn't white space alone.  It has a vector of its own, made of two parts: ``DIGEST`` lanes of
SHAKE-128 over its bytes, and a sketch of ``LANES`` lanes, in which each of its distinct windows of three words (all
words of a shorter paragraph) adds 1 to or takes 1 from one lane.  A document's fingerprint is the sum of its
paragraphs' vectors modulo 2 ** 32, so it doesn't depend on their order, and a paragraph is put in or taken out by adding
or subtracting its vector (``insert``, ``delete``).  Equal multisets of paragraphs have equal fingerprints; unequal ones
differ in the digest lanes but for a chance of about 2 ** -1024 (keyless sums are no defence against a forger).

The sketch is what likeness is read from: the product of two sketches estimates how many windows are shared, whatever
the texts' lengths, and the cosine of two unrelated texts is 0 within about 1 / sqrt(LANES) = 0.044.  Equal fingerprints
are alike by 1; a text without words is like nothing but its own kind.

A fingerprint is written as base64 of the digest lanes, the number of bits that the sketch's lanes need, and these.

Defined cases: a null text counts as empty: the sum of nothing.  Repeated paragraphs count as often as they stand there.
Texts of any length go through one task line by line.  ``edited_pairs`` orders by id (nulls first), texts of one id by
hash and text; the last row's next one is the first, also where it is the only one.  An empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, materialize, mix, record_batch, released, text_bytes

#: Lanes of 32 bits: of the digest, of the sketch.
DIGEST, LANES = 32, 512
#: Words of a window.
WINDOW = 3
_M32 = np.uint64(0xFFFFFFFF)


def _sketched(lines: list[list[bytes]], owners: np.ndarray, n: int, words: WordHashes) -> np.ndarray:
    """For each of n texts the sum of its paragraphs' sketches: each paragraph's windows count once in it."""
    if not lines:
        return np.zeros((n, LANES), np.int64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = words.of([w for line in lines for w in line])
    line_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[line_of]
    starts = np.flatnonzero((place + WINDOW <= sizes[line_of]) | (place == 0))
    line, window = line_of[starts], np.zeros(len(starts), np.uint64)
    left = np.minimum(sizes[line], WINDOW)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            on = left > i
            window[on] = window[on] * np.uint64(0x9E3779B97F4A7C15) + h[starts[on] + i] + np.uint64(1)
        window = mix(window)
        _, once = np.unique(mix(window + line.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), return_index=True)
    window, lane = window[once], owners[line[once]] * LANES
    lane += (window >> np.uint64(1)).astype(np.int64) % LANES
    sign = 1 - 2 * (window & np.uint64(1)).astype(np.int64)
    return np.bincount(lane, weights=sign, minlength=n * LANES).astype(np.int64).reshape(n, LANES)


def vectors(raws: list[bytes], words: WordHashes | None = None) -> np.ndarray:
    """The fingerprints of texts, each as DIGEST + LANES numbers modulo 2 ** 32."""
    lines, owners, digests = [], [], []
    for i, raw in enumerate(raws):
        for line in raw.split(b"\n"):
            if split := line.split():
                lines.append(split)
                owners.append(i)
                digests.append(hashlib.shake_128(line).digest(4 * DIGEST))
    out = np.zeros((len(raws), DIGEST + LANES), np.uint64)
    np.add.at(out[:, :DIGEST], owners, np.frombuffer(b"".join(digests), "<u4").reshape(-1, DIGEST).astype(np.uint64))
    out[:, DIGEST:] = _sketched(lines, np.array(owners, np.int64), len(raws), WordHashes() if words is None else words).astype(np.uint64)
    return out & _M32


def vector(raw: bytes) -> np.ndarray:
    return vectors([raw])[0]


def insert(sum_: np.ndarray, raw: bytes) -> np.ndarray:
    """The fingerprint with the paragraphs of ``raw`` put in."""
    return (sum_ + vector(raw)) & _M32


def delete(sum_: np.ndarray, raw: bytes) -> np.ndarray:
    """The fingerprint with the paragraphs of ``raw`` taken out."""
    return (sum_ - vector(raw)) & _M32


def encode(sum_: np.ndarray) -> str:
    lanes = sum_[DIGEST:].astype(np.uint32).view(np.int32).astype(np.int64)
    zigzag = np.where(lanes < 0, -2 * lanes - 1, 2 * lanes)
    width = int(zigzag.max()).bit_length()
    bits = ((zigzag[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    return base64.b64encode(sum_[:DIGEST].astype("<u4").tobytes() + bytes([width]) + np.packbits(bits, bitorder="little").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = base64.b64decode(text)
    width = raw[4 * DIGEST]
    bits = np.unpackbits(np.frombuffer(raw[4 * DIGEST + 1 :], np.uint8), bitorder="little")[: LANES * width].reshape(LANES, width)
    zigzag = (bits.astype(np.int64) << np.arange(width)).sum(axis=1)
    lanes = np.where(zigzag & 1, -(zigzag + 1) // 2, zigzag // 2)
    return np.concatenate([np.frombuffer(raw[: 4 * DIGEST], "<u4").astype(np.uint64), lanes.astype(np.uint64) & _M32])


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[DIGEST:].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    norms = float(x @ x) * float(y @ y)
    return min(1.0, max(0.0, float(x @ y) / norms**0.5)) if norms else 0.0


def likeness(a: Column, b: Column) -> Column:
    """How alike two written fingerprints are, from 0 to 1; null if one is null."""

    @F.pandas_udf("double")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _cosine(decode(x), decode(y)) for x, y in zip(left, right, strict=True)], dtype="float64")

    return alike(a, b)


def fingerprint(text: Column) -> Column:
    """The written fingerprint of each text."""

    @F.pandas_udf("string")
    def written(raws: pd.Series) -> pd.Series:
        words = WordHashes()
        return pd.Series([encode(v) for part in _groups(raws) for v in vectors(part, words)], dtype=object)

    return written(text_bytes(text))


_ROW = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PAIR_ARROW = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_PART_ARROW = pa.schema([*_PAIR_ARROW, ("part", pa.int64()), ("edge", pa.string()), ("raw", pa.binary())])


def _edit(raw: bytes, after: bytes) -> tuple[int, bytes, int]:
    """A text's code points, the text whose last half is the start of the next one, and how many bytes of it are the old ones."""
    text = raw.decode("utf-8", "surrogateescape")
    half = len(text) // 2
    kept = text[: len(text) - half].encode("utf-8", "surrogateescape")
    start = after[: 4 * half + 4].decode("utf-8", "surrogateescape")[:half]  # a code point has four bytes at most
    return len(text), kept + start.encode("utf-8", "surrogateescape"), len(kept)


def _rows(chain: list[bytes], words: WordHashes) -> list[list]:
    """The result's columns for the texts of a chain but its last one, which is only their end.

    An edited text's fingerprint comes from the text's: the paragraphs that the edit touches are taken out, the new ones
    put in.
    """
    n, new, old_rest, new_rest = [], [], [], []
    for raw, next_ in itertools.pairwise(chain):
        chars, text, kept = _edit(raw, next_)
        line = raw.rfind(b"\n", 0, kept) + 1  # the line that the edit begins in
        n.append(chars)
        new.append(hashlib.sha256(text).hexdigest())
        old_rest.append(raw[line:])
        new_rest.append(text[line:])
    k = len(n)
    every = vectors([*chain, *old_rest, *new_rest], words)
    sums, edited = every[:k], (every[:k] - every[k + 1 : -k] + every[-k:]) & _M32
    return [n, new, *([encode(v) for v in x] for x in (sums, edited)), *([_cosine(x, y) for x, y in zip(sums, others, strict=True)] for others in (edited, every[1 : k + 1]))]


#: Texts that are hashed at once: so many, or so many bytes and the text beyond.
GROUP, GROUP_BYTES = 64, 1 << 18


def _groups(texts) -> Iterator[list]:
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x if isinstance(x, bytes) else x[1])
        if len(group) >= GROUP or size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


@released
def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one of its partition; of the first and last row the text, for the partitions beside."""
    part, words = TaskContext.get().partitionId(), WordHashes()

    def edge(name: str, id_: int | None, raw: bytes) -> pa.RecordBatch:
        return record_batch(_PART_ARROW, *([x] for x in (id_, *(None,) * 6, part, name, raw)))

    last = None
    for batch in batches:
        for group in _groups(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if last is None:
                yield edge("first", *group[0])
            else:
                group.insert(0, last)
            last = group[-1]
            if len(group) > 1:
                nothing = [None] * (len(group) - 1)
                yield record_batch(_PART_ARROW, [id_ for id_, _ in group[:-1]], *_rows([raw for _, raw in group], words), nothing, nothing, nothing)
    if last is not None:
        yield edge("last", *last)


@released
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        for row in batch.to_pylist():
            yield record_batch(_PAIR_ARROW, [row["id"]], *_rows([row["end"], row["start"]], words))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose second half gives way to the next document's start, and likenesses.

    One range shuffle by id brings neighbours together.  A partition's last row meets the first one of the next
    partition that has rows, by a join of two rows a partition.
    """
    raw = text_bytes(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"), F.xxhash64(raw).alias("h")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "raw")
    found = materialize(rows.select("id", "raw").mapInArrow(_pairs, f"{_ROW}, part long, edge string, raw binary"), "pairs")
    inside, edges = found.filter("edge is null").drop("part", "edge", "raw"), found.filter("edge is not null")
    parts = edges.filter("edge = 'first'").select("part")  # two rows a partition
    whole = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(whole), F.first("part").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    ends = edges.filter("edge = 'last'").select("part", "id", F.col("raw").alias("end")).join(after, "part")
    starts = edges.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("raw").alias("start"))
    return inside.unionByName(ends.join(starts, "next").select("id", "end", "start").mapInArrow(_across, _ROW))
