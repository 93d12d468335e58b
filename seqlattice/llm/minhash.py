"""MinHash near-dedup with tensored banding.

A document's set is its distinct shingles of ``shingle`` words.  ``GROUPS`` small collections of ``DEPTH`` minhashes
each are computed once; every pair of collections is a table, its key the two collections' values together.  So
GROUPS * (GROUPS - 1) / 2 tables of 2 * DEPTH minhashes need GROUPS * DEPTH minhashes in all.

Documents of equal sets are one class and are never compared.  Within each task, a bucket's classes are put together
first, so the largest bucket brings one row from each task to the shuffle.  In each bucket all classes are paired with
one center, the class that meets most others; candidates are confirmed on full sets, and links become components.
Classes of one center that are then in different components are gone through once more, against all others of that
center and in bounded blocks, so that no link is lost to the choice of the center.

Defined cases: null and empty texts have the empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle.  Rows that repeat wholly are of one class.  A null id never is the smallest of a component.  An
empty table gives no rows.  Only the id and text columns are read, so other columns can't clash.  A text of any length is
one set, whole in one task.  Sets are compared by the 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WordHashes, components, filter_slots, key_filter, list_array, materialize, may_hold, mix, record_batch, released, text_bytes, text_key, window_hashes

SHINGLE, PERCENT = 5, 85
GROUPS, DEPTH = 14, 3
#: Classes of a block, where a group is gone through; a larger group is dealt out as pairs of blocks.
BLOCK = 4_000

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 63, GROUPS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, GROUPS * DEPTH, np.uint64)
_PAIRS = np.array(list(combinations(range(GROUPS), 2)), np.int64)

_SIGNED = "doc_id long, rep binary, set_key binary, n_shingles long, halves array<long>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("rep", pa.binary()), ("set_key", pa.binary()), ("n_shingles", pa.int64()), ("halves", pa.list_(pa.int64()))])


def shingles(raw: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = raw.translate(LOWER).split()
    h = hashes.of(words)
    if 0 < len(h) < size:
        return window_hashes(np.append(h, np.uint64(len(h))), len(h) + 1)
    return np.unique(window_hashes(h, size))


def half_keys(found: np.ndarray) -> np.ndarray:
    """The value of each collection: its minhashes put together."""
    out = np.empty(GROUPS * DEPTH, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(len(out)):
            out[i] = (found * _MULTIPLY[i] + _ADD[i]).min()
        return mix((mix(out).reshape(GROUPS, DEPTH) * np.arange(3, 3 + 2 * DEPTH, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))


@released
def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        keys, counts, halves = [], [], []
        for raw in batch.column(2).to_pylist():
            found = shingles(raw, hashes, size)
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            counts.append(len(found))
            halves.append(half_keys(found) if len(found) else np.empty(0, np.uint64))
        flat = np.concatenate([np.empty(0, np.uint64), *halves]).view(np.int64)
        yield record_batch(_SIGNED_ARROW, batch.column(0), batch.column(1), keys, counts, list_array(pa.array(flat), [len(h) for h in halves]))


_BUCKETS = pa.schema([("key", pa.int64()), ("center", pa.int64()), ("member", pa.int64())])


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and id: keys, each row's smallest id of its key, ids, and where a key begins."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])
    starts = np.flatnonzero(new)
    return keys, ids[starts][np.cumsum(new) - 1] if len(keys) else ids, ids, new


@released
def _local_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows of a task's classes: (key, center, member) of what meets here, and (key, null, center) for the shuffle."""
    n_tables = len(_PAIRS)
    for batch in (part for b in batches for part in (b.slice(i, 2_500) for i in range(0, b.num_rows, 2_500))):
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        halves = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), GROUPS)
        with np.errstate(over="ignore"):
            keys = mix(halves[:, _PAIRS[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + halves[:, _PAIRS[:, 1]] * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(n_tables, dtype=np.uint64)).view(np.int64).ravel()
        keys, centers, members, new = _stars(keys, np.repeat(ids, n_tables))
        yield record_batch(_BUCKETS, keys[~new], centers[~new], members[~new])
        yield record_batch(_BUCKETS, keys[new], pa.nulls(int(new.sum()), pa.int64()), members[new])


@released
def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by key and id; the smallest id of a key is paired with every other."""
    key, center = None, 0
    for batch in batches:
        keys, ids = (batch.column(i).to_numpy() for i in range(2))
        if not len(keys):
            continue
        new = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
        starts = np.where(new, np.arange(len(keys)), -1)
        at = np.maximum.accumulate(starts)
        centers = np.where(at >= 0, ids[at], center)
        key, center = keys[-1], centers[-1]
        yield record_batch(_BUCKETS, keys[~new], centers[~new], ids[~new])


@released
def _sets(batches: Iterator[pa.RecordBatch], size: int, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    schema = pa.schema([("set_key", pa.binary()), ("shingles", pa.binary())])
    words = wanted.value
    for batch in batches:
        some = batch.filter(pa.array(may_hold(words, batch.column(2))))
        keys, packed = [], []
        for raw in some.column(1).to_pylist():
            found = shingles(raw, hashes, size)
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            packed.append(found.astype("<u8").tobytes())
        yield record_batch(schema, keys, packed)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8")


def _across(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the components of classes that share a center: enough of them that all who are linked are connected.

    Two classes have in common at most what both share with the center, and what they share beside it.  The latter is
    counted with an inverted index of the shingles that aren't the center's, which are few where the center is like
    them; what this bound leaves over is intersected.
    """
    group = group.sort_values("member", ignore_index=True)
    center = int(np.flatnonzero((group["member"] == group["center"]).to_numpy())[0])
    sets = [_unpack(p) for p in group["shingles"]]
    n = np.array([len(x) for x in sets], np.int64)
    inside = [np.isin(x, sets[center], assume_unique=True) for x in sets]
    shared = np.array([m.sum() for m in inside], np.int64)
    beside = [x[~m] for x, m in zip(sets, inside, strict=True)]
    tokens = np.concatenate(beside)
    holder = np.repeat(np.arange(len(sets)), n - shared)
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]

    root = group["root"].to_numpy(copy=True)
    member = group["member"].to_numpy()
    found: list[tuple[int, int]] = []
    for x in np.flatnonzero(root != root[center]):
        low, high = np.searchsorted(tokens, beside[x], "left"), np.searchsorted(tokens, beside[x], "right")
        many = high - low
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        most = np.minimum(shared, shared[x]) + np.bincount(holder[at], minlength=len(sets))
        for y in np.flatnonzero((100 * most >= percent * (n + n[x] - most)) & (root != root[x])):
            if root[x] == root[y]:
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (n[x] + n[y] - common):
                found.append((int(member[x]), int(member[y])))
                root[root == root[y]] = root[x]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


@F.pandas_udf(T.LongType())
def _common(left: pd.Series, right: pd.Series) -> pd.Series:
    out, last, unpacked = [], None, np.empty(0)
    for a, b in zip(left, right, strict=True):
        if a is not last:
            last, unpacked = a, _unpack(a)
        both = np.concatenate([unpacked, _unpack(b)])
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pd.Series(out, dtype="int64")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart: the text's 16 bytes and its id."""
    return F.concat(text_key(F.col(text_col)), F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, rep (``row_key``), set_key, n_shingles and the collections' values of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("rep"), text_bytes(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(partial(_sign, size=size), _SIGNED)


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, rep, n_shingles, component_id and root of every row; links are those of ``percent`` % Jaccard similarity or more.

    ``root`` is one number for each component, null where the set is empty; ``rep`` tells rows of one id apart.
    """
    spark = docs.sparkSession
    rows = materialize(signed(docs, id_col, text_col, size), "signatures")
    grouped = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_min"), F.min("rep").alias("rep"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    local = materialize(classes.select("cid", "halves").mapInArrow(_local_buckets, "key long, center long, member long"), "buckets")
    across = local.filter("center is null").select("key", "member").repartition("key").sortWithinPartitions("key", "member").mapInArrow(_bucket_stars, "key long, center long, member long")
    shared = local.filter("center is not null").unionByName(across)
    both_ends = shared.select("key", F.explode(F.array("center", "member")).alias("member"))
    members = materialize(both_ends.groupBy("key", "member").agg(F.lit(1).alias("one")).select("key", "member"), "members")

    # The center of a bucket is the class that meets most others in all of its buckets: of copies, mostly the original.
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    degree = materialize(members.join(sizes, "key").groupBy("member").agg(F.sum("size").alias("degree")), "degrees")
    ranked = materialize(members.join(degree, "member").groupBy("key").agg(F.max(F.struct("degree", "member")).alias("top")).select("key", F.col("top.member").alias("center")), "centers")
    pairs = members.join(ranked, "key").filter("member <> center").groupBy(F.col("center").alias("a"), F.col("member").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")

    involved = materialize(degree.select(F.col("member").alias("cid")).join(classes.select("cid", "rep", "set_key", "n"), "cid"), "involved")
    wanted = spark.sparkContext.broadcast(key_filter(involved, "rep"))
    rep = row_key(id_col, text_col)
    read = docs.select(rep.alias("rep"), text_bytes(F.col(text_col)).alias("raw"), filter_slots(rep).alias("slots")).mapInArrow(partial(_sets, size=size, wanted=wanted), "set_key binary, shingles binary")
    sets = materialize(read.join(involved, "set_key").dropDuplicates(["cid"]).select("cid", "n", "shingles"), "sets")

    def alike(common: Column) -> Column:
        return 100 * common >= percent * (F.col("na") + F.col("nb") - common)

    def confirmed(near: DataFrame, tag: str) -> DataFrame:
        """Of pairs (a, b, na, nb) those whose full sets are alike; sizes that can't be are gone before the sets are read."""
        both = near.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("right")), "b").join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("left")), "a")
        met = both.select("a", "b", "na", "nb", _common("left", "right").alias("common"))
        return materialize(met.filter(alike(F.col("common"))).select("a", "b"), f"{tag}-links")

    sized = involved.select("cid", "n")
    near = pairs.join(sized.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b")
    links = confirmed(materialize(near.filter(alike(F.least("na", "nb"))), "pairs"), "first")
    roots = materialize(components(links), "roots")

    # Groups of one center that hold several components are gone through for links between these, in blocks of classes.
    label = roots.select(F.col("id").alias("member"), "root")
    centered = pairs.select(F.col("a").alias("center"), F.col("b").alias("member"))
    whole = centered.unionByName(centered.select("center", F.col("center").alias("member")).distinct())
    labelled = whole.join(label, "member", "left").withColumn("root", F.coalesce("root", "member"))
    mixed = labelled.groupBy("center").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low <> high").select("center", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_ = labelled.join(mixed, "center").withColumn("block", F.pmod(F.xxhash64("member"), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    dealt = open_.withColumn("pair", F.explode(F.when(F.col("member") == F.col("center"), every).otherwise(others)))
    dealt = materialize(dealt.select("center", "member", "root", F.col("pair.i").alias("i"), F.col("pair.j").alias("j")), "open")
    group = dealt.join(sets.select(F.col("cid").alias("member"), "shingles"), "member").select("center", "i", "j", "member", "root", "shingles")

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        return _across(rows, percent)

    more = materialize(group.groupBy("center", "i", "j").applyInPandas(across, "a long, b long"), "second-links")
    labels = components(links.unionByName(more))

    found = classes.join(labels.select(F.col("id").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = found.groupBy("root").agg(F.min("doc_min").alias("component_id"))
    of_class = found.join(lowest, "root").select("set_key", "component_id", "root")
    return rows.select("doc_id", "rep", "set_key", "n_shingles").join(of_class, "set_key", "left").select("doc_id", "rep", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")
