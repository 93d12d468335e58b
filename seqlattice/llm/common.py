"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import swept, written

#: A-Z to a-z; every other byte stays, so UTF-8 stays valid.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The white space of the contracts; ``bytes.split()`` and ``bytes.strip()`` use the same six bytes.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    return written(df, tag, "zstd")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def tokenizer_path(name: str, path: str | None = None) -> str:
    """The file of a public vocabulary: ``path`` (a folder) if given, else where the box keeps them."""
    if path:
        return os.path.join(path, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def list_array(values: pa.Array, counts) -> pa.ListArray:
    """A list column of ``counts[i]`` consecutive values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


@cache
def _allocator():
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def released(work):
    """For a map function over batches: when a task ends, its memory goes back, as the worker lives on beside others."""

    @wraps(work)
    def mapped(*args, **kwargs):
        yield from work(*args, **kwargs)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _allocator() is not None:
            _allocator()(0)

    return mapped


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process; kept up to a number of words, then begun anew."""

    ROOM = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive numbers; empty if there are fewer."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


#: Bits of a filter: a broadcast of 4 MB whatever the input; a full one only lets more rows pass.
FILTER_BITS = 25


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the long ``column``: at most 2 ** (bits - 6) rows of two longs come to the driver."""
    slots = F.explode(F.array(*(F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(k)), 64 - bits) for k in range(3))))
    words = keys.select(slots.alias("slot")).select((F.shiftright("slot", 6)).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    with swept(keys.sparkSession):
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def filter_slots(column: Column, bits: int = FILTER_BITS) -> Column:
    """The slots of a long key, for ``may_hold``."""
    return F.array(*(F.shiftrightunsigned(F.xxhash64(column, F.lit(k)), 64 - bits) for k in range(3)))


def may_hold(words: np.ndarray, slots: pa.ListArray) -> np.ndarray:
    at = slots.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3) if len(slots) else np.empty((0, 3), np.int64)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, root) of every id in the links (a, b): root is the smallest id that can be reached.

    Stars of the larger and of the smaller neighbours in turn (hash-to-min), each a grouped minimum and a join, until
    nothing changes; every turn is written to the shared folder.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), tag)
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = materialize(small.filter("u <> v").distinct(), tag)
