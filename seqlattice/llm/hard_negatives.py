"""Hard negatives of embeddings: threshold joins by an inverted index with norm bounds (after L2AP).

Every anchor is scored by inner products with all rows; its positives are the best rows of its label, and for each
positive the best rows of other labels whose score lies in a window below the positive's are its hard negatives.

Rows are packed into blocks of about ``ROWS`` vectors, anchors into blocks of about ``ANCHORS``, and each block of rows
meets each block of anchors once: a stated set of queries against all rows, dealt out by pairs of blocks, so that no
task holds more than two blocks, whatever the labels, copies or norms.

Within a pair of blocks, dimensions are taken by falling weight.  A row's dimensions are in the index only up to where
the norm of what remains, times that of the anchors, stays below the threshold: the rest can't bring any pair to it
alone and is left out.  Chunk by chunk of the index the partial scores are accumulated; a pair whose score so far and
product of remaining norms stay below its threshold is dropped.  For the pairs that live, the omitted dimensions are
added.  Thresholds start high and are lowered, for the anchors whose windows aren't full, until they are or the window's
lower end is reached.  Nothing is approximate: a bound only drops pairs that can't reach the threshold.

A block yields as many rows as a window takes for each anchor and positive, and window functions keep the best of all
blocks.

Defined cases: a row with a null label, a null vector or a component that is null, NaN or infinite takes no part.  An
empty vector is one of zeros, and shorter vectors are filled with zeros.  Rows with an anchor's id are neither
positives nor negatives of it; a row with a null id is no anchor, stands behind all ids in ties, and is returned with a null id.  Rows that
repeat are scored each for itself, and a repeated anchor is answered as often.  A score is exact; one beyond the range of a
long becomes its end.  A positive whose window is empty (such as one of negative score) has no rows.  An empty table gives
no rows.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, record_batch, released

#: Vectors of a block of rows, of a block of anchors, and of the anchors that are scored at once.
ROWS, ANCHORS, AT_ONCE = 8_192, 2_048, 128
#: Dimensions that are accumulated between two rounds of pruning.
CHUNK = 16
#: How thresholds fall: for positives as shares of the greatest score that norms allow, for negatives as shares of the
#: way from a positive's score to its window's lower end.
POSITIVE_STEPS, NEGATIVE_STEPS = (0.8, 0.6, 0.4, 0.2), (0.25, 0.5, 1.0)
#: Stands for a null id: behind all others.
NO_ID = (1 << 63) - 1
#: Sums of products below this are exact in doubles; beyond it whole numbers of any size are used.
EXACT = float(1 << 53)
#: Components are cut here, far beyond what a score can hold.
MOST = 1e140

_PACKED = "block long, n long, kind string, ids binary, labels binary, vectors binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
_POSITIVE = "block long, anchor int, other_id long, score long"
_POSITIVE_ARROW = pa.schema([("block", pa.int64()), ("anchor", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = "block long, anchor int, place int, anchor_id long, positive_id long, positive_score long, other_id long, score long"
_NEGATIVE_ARROW = pa.schema([("block", pa.int64()), ("anchor", pa.int32()), ("place", pa.int32()), *((c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "other_id", "score"))])


def usable(rows: DataFrame, id_: Column, label: Column, vector: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    named = rows.select(id_.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector"))
    return named.filter("label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


@released
def _pack(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """All rows of a partition as one block: ids, labels and a matrix of the floors of the components' ``scale``-fold."""
    ids, labels, parts = [], [], []
    for batch in batches:
        ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
        labels.append(batch.column(1).to_numpy(zero_copy_only=False))
        lists = batch.column(2)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = np.floor(np.clip(lists.flatten().to_numpy(zero_copy_only=False), -MOST, MOST) * scale)
        part = np.zeros((len(counts), int(counts.max(initial=0))))
        part[np.arange(part.shape[1]) < counts[:, None]] = flat
        parts.append(part)
    n = sum(map(len, ids))
    if n:
        wide = np.zeros((n, max(p.shape[1] for p in parts)))
        at = 0
        for part in parts:
            wide[at : at + len(part), : part.shape[1]] = part
            at += len(part)
        most = np.abs(wide).max(initial=0)
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
        yield record_batch(_PACKED_ARROW, [TaskContext.get().partitionId()], [n], [kind], [np.concatenate(ids).astype("<i8").tobytes()], [np.concatenate(labels).astype("<i8").tobytes()], [wide.astype(kind).tobytes()])


def packed(rows: DataFrame, size: int, scale: float, tag: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, dealt out in turn, so that no id, label or copy decides on a block; and their number."""
    n = max(1, -(-rows.count() // size))
    return materialize(rows.repartition(n).mapInArrow(partial(_pack, scale=scale), _PACKED), tag), n


def _matrix(row: dict) -> np.ndarray:
    values = np.frombuffer(row["vectors"], row["kind"])
    return values.reshape(row["n"], len(values) // row["n"]).astype(np.float64)


class Index:
    """An inverted index of a block of rows: (dimension, row, value) by chunks of dimensions, the heaviest first."""

    def __init__(self, rows: np.ndarray, width: int):
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
        self.order = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
        self.rows = rows[:, self.order]
        self.edges = [*range(0, width, CHUNK), width]
        self.norms = self._norms(self.rows)

    def _norms(self, x: np.ndarray) -> np.ndarray:
        """Of what remains from each edge on, rounded up."""
        squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1)[:, self.edges]) * (1 + 1e-9)

    def search(self, anchors: np.ndarray, least: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is at least the anchor's threshold; of the rows ``among``, if given."""
        x = np.pad(anchors, ((0, 0), (0, self.rows.shape[1] - anchors.shape[1])))[:, self.order]
        rows, norms = (self.rows, self.norms) if among is None else (self.rows[among], self.norms[among])
        mine = self._norms(x)
        where = np.arange(len(rows)) if among is None else among
        if mine[:, 0].max(initial=0) * norms[:, 0].max(initial=0) >= EXACT:
            scores = np.clip(np.vectorize(int, otypes=[object])(x) @ np.vectorize(int, otypes=[object])(rows).T, -(1 << 63), NO_ID) if x.size and rows.size else np.zeros((len(x), len(rows)), np.int64)
            a, r = np.nonzero(scores >= least[:, None])
            return a, where[r], scores[a, r].astype(np.int64)
        # how many chunks of each row are in the index: what follows stays below every threshold
        with np.errstate(divide="ignore", invalid="ignore"):
            limits = np.where(mine > 0, least[:, None] / mine, np.where(least[:, None] > 0, np.inf, -np.inf)).min(axis=0, initial=np.inf)[:-1]
        chunks = len(limits)
        depth = (norms[:, :-1] >= limits).sum(axis=1) if chunks else np.ones(len(rows), np.int64)
        keep = np.flatnonzero(depth > 0) if (least > 0).all() else np.arange(len(rows))
        keep = keep[np.argsort(-depth[keep], kind="stable")]  # the rows of a chunk's postings come first
        rows, norms, depth, where = rows[keep], norms[keep], depth[keep], where[keep]
        scores, live = np.zeros((len(x), len(rows))), np.ones((len(x), len(rows)), bool)
        floor = least[:, None] - 1e-6
        for c in range(chunks):
            on = int(np.searchsorted(-depth, -c))  # depth > c
            if not on:
                break
            dims = slice(self.edges[c], self.edges[c + 1])
            scores[:, :on] += x[:, dims] @ rows[:on, dims].T
            live[:, :on] &= scores[:, :on] + mine[:, c + 1, None] * norms[:on, c + 1] >= floor
            some = live.any(axis=0)
            if 2 * some.sum() < len(some):
                rows, norms, depth, where, scores, live = rows[some], norms[some], depth[some], where[some], scores[:, some], live[:, some]
        a, r = np.nonzero(live)
        exact = scores[a, r]
        for c in range(chunks):  # what the index left out
            rest = np.flatnonzero(depth[r] <= c)
            dims = slice(self.edges[c], self.edges[c + 1])
            for part in np.array_split(rest, len(rest) // 100_000 + 1):
                exact[part] += np.einsum("ij,ij->i", x[a[part], dims], rows[r[part], dims])
        reached = exact >= least[a]
        return a[reached], where[r[reached]], exact[reached].astype(np.int64)


def _best(a: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by anchor, falling score, id."""
    return np.lexsort((ids, -scores, a))


def _positives(rows: dict, anchors: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, id, score) of each anchor's best ``k`` rows of its label in the block."""
    vectors, queries = _matrix(rows), _matrix(anchors)
    ids, labels, own, of = (np.frombuffer(r[c], "<i8") for r in (rows, anchors) for c in ("ids", "labels"))
    index = Index(vectors, max(vectors.shape[1], queries.shape[1]))
    by_label = np.argsort(labels, kind="stable")
    for label in np.unique(of):
        among = by_label[np.searchsorted(labels[by_label], label) : np.searchsorted(labels[by_label], label, side="right")]
        if not len(among):
            continue
        mine = np.flatnonzero(of == label)
        for open_ in np.split(mine, range(AT_ONCE, len(mine), AT_ONCE)):
            most = np.sqrt((queries[open_] ** 2).sum(axis=1)) * index.norms[among, 0].max()
            for step in (*POSITIVE_STEPS, None):
                if not len(open_) or len(among) <= k and step is not None:
                    continue
                a, r, s = index.search(queries[open_], np.full(len(open_), -np.inf) if step is None else most * step, among)
                other = ids[r] != own[open_[a]]
                a, r, s = a[other], r[other], s[other]
                full = np.bincount(a, minlength=len(open_)) >= k
                done = full | (step is None)
                order = _best(a, ids[r], s)
                a, r, s = a[order], r[order], s[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                take = (place < k) & done[a]
                yield open_[a[take]], ids[r[take]], s[take]
                open_, most = open_[~done], most[~done]


def _negatives(rows: dict, anchors: dict, k: int, share: tuple[int, int]) -> Iterator[tuple]:
    """(anchor, place, positive id, its score, id, score): the best ``k`` rows of other labels in each positive's window."""
    vectors, queries = _matrix(rows), _matrix(anchors)
    ids, labels, own, of = (np.frombuffer(r[c], "<i8") for r in (rows, anchors) for c in ("ids", "labels"))
    index = Index(vectors, max(vectors.shape[1], queries.shape[1]))
    windows: dict[int, list] = {}
    for p in anchors["positives"]:
        low = -(-share[0] * p["score"] // share[1])  # the least score with share[0] * positive <= share[1] * negative
        if low <= p["score"]:
            windows.setdefault(p["anchor"], []).append((p["place"], p["other_id"], p["score"], low))
    asked = np.array(sorted(windows), np.int64)
    for open_ in np.split(asked, range(AT_ONCE, len(asked), AT_ONCE)):
        for step in NEGATIVE_STEPS:
            if not len(open_):
                break
            low = np.array([min(w[3] for w in windows[i]) for i in open_], np.float64)
            top = np.array([min(w[2] for w in windows[i]) for i in open_], np.float64)
            least = low if step == NEGATIVE_STEPS[-1] else np.maximum(np.ceil(top - (top - low) * step), low)
            a, r, s = index.search(queries[open_], least)
            other = (labels[r] != of[open_[a]]) & (ids[r] != own[open_[a]])
            a, r, s = a[other], r[other], s[other]
            order = _best(a, ids[r], s)
            a, r, s = a[order], r[order], s[order]
            edges = np.searchsorted(a, np.arange(len(open_) + 1))
            left = []
            for i, anchor in enumerate(open_):
                part = slice(edges[i], edges[i + 1])
                falling, found = -s[part], []
                for place, positive, score, window_low in windows[anchor]:
                    begin, end = np.searchsorted(falling, -score), np.searchsorted(falling, -window_low, side="right")
                    found.append((place, positive, score, begin + edges[i], min(end, begin + k) + edges[i], end - begin >= k or least[i] <= window_low))
                if all(f[5] for f in found):
                    for place, positive, score, begin, end, _ in found:
                        for j in range(begin, end):
                            yield anchor, place, positive, score, ids[r[j]], s[j]
                else:
                    left.append(anchor)
            open_ = np.array(left, np.int64)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, dict]]:
    for pair in batch.to_pylist():
        yield pair["rows"], pair["anchors"]


@released
def _map_positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, anchors in _rows_of(batch):
            for a, ids, scores in _positives(rows, anchors, k):
                yield record_batch(_POSITIVE_ARROW, np.full(len(a), anchors["block"]), a.astype(np.int32), ids, scores)


@released
def _map_negatives(batches: Iterator[pa.RecordBatch], k: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, anchors in _rows_of(batch):
            own = np.frombuffer(anchors["ids"], "<i8")
            found = [(anchors["block"], a, place, own[a], *rest) for a, place, *rest in _negatives(rows, anchors, k, share)]
            if found:
                yield record_batch(_NEGATIVE_ARROW, *map(list, zip(*found, strict=True)))


def _pairs(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int) -> DataFrame:
    """Each block of rows beside each block of anchors: both are written once for each block of the other side."""
    def numbered(blocks: DataFrame, name: str, others: int) -> DataFrame:
        return blocks.select(F.struct(*blocks.columns).alias(name), F.col("block").alias(f"{name}_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias("other"))

    keys = ["rows_block", "anchors_block"]
    left = numbered(rows, "rows", n_anchors).withColumnRenamed("other", "anchors_block")
    right = numbered(anchors, "anchors", n_rows).withColumnRenamed("other", "rows_block")
    tasks = min(n_rows * n_anchors, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows * n_anchors // 32))
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).select("rows", "anchors")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """Of rows (id, label, vector), see ``usable``: the hard negatives of each anchor and positive.

    ``anchors`` is a condition on rows.  Columns: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.  A window reaches from the positive's score down to ``share`` of it.
    """
    rows, n_rows = packed(vectors, ROWS, scale, "rows")
    asked, n_asked = packed(vectors.filter(anchors), ANCHORS, scale, "anchors")
    near = _pairs(rows, n_rows, asked, n_asked).mapInArrow(partial(_map_positives, k=positives), _POSITIVE)
    best = _first(near, ["block", "anchor"], positives)
    listed = best.groupBy("block").agg(F.collect_list(F.struct("anchor", F.col("rank").alias("place"), "other_id", "score")).alias("positives"))  # of one block's anchors
    known = materialize(asked.join(listed, "block"), "positives")
    far = _pairs(rows, n_rows, known, n_asked).mapInArrow(partial(_map_negatives, k=negatives, share=share), _NEGATIVE)
    found = _first(far, ["block", "anchor", "place"], negatives)
    id_ = {c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("positive_id", "other_id")}
    return found.select("anchor_id", id_["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), id_["other_id"].alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
