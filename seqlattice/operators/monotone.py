"""Monotone alignment of what was expected with what was heard, by key: neighbours that were split are joined, others are left out.

The items of a key are aligned with its intervals in order.  An item takes one interval or up to ``most`` neighbours; an
interval may be left out.  A joined span costs its distance from the length that the item's size leads to expect, as a
share of it, and ``JOIN`` for each interval after the first; an interval left out costs ``DROP``.  Lengths are a line over
sizes, fitted on pairs in order first, then on what was found, twice.

As every item takes at least one interval, the number of intervals ahead of the items only grows along a way, from 0 to
their difference in number.  So the table is a band of that width, without loss; it is filled a row at a time.  Keys are
dealt out by a shuffle and streamed in order: a task holds one key's rows and a byte for each cell of its band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs, the line before anything is fitted, and how many pairs a fit needs.
JOIN, DROP, LEAST_LENGTH = 0.25, 1.5, 0.1
LINE, LEAST_PAIRS, ROUNDS = (1.2, 0.13), 8, 2
_ALIGNED = "key string, item long, first long, last long, start double, stop double"
_ARROW = pa.schema([("key", pa.string()), ("item", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("start", pa.float64()), ("stop", pa.float64())])


def _line(sizes: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    if len(sizes) < LEAST_PAIRS:
        return LINE
    return tuple(np.linalg.lstsq(np.stack([np.ones(len(sizes)), sizes], axis=1), lengths, rcond=None)[0])


def cheapest(sizes: np.ndarray, start: np.ndarray, stop: np.ndarray, line: tuple[float, float], most: int) -> tuple[float, list[tuple[int, int]]]:
    """(cost, the first and last interval of each item) under a line; of equal costs fewer intervals, then no interval left out, win."""
    n, ahead = len(sizes), len(start) - len(sizes)
    at = np.arange(ahead + 1)
    choice = np.zeros((n, ahead + 1), np.int8)
    below = DROP * (ahead - at).astype(float)  # behind the last item all that is left goes
    for i in range(n - 1, -1, -1):
        expected = line[0] + line[1] * sizes[i]
        row, took = np.full(ahead + 1, np.inf), np.zeros(ahead + 1, np.int8)
        for k in range(1, most + 1):
            d = at[: ahead + 2 - k]  # k - 1 more intervals are ahead afterwards
            if not len(d):
                break
            cost = np.abs(stop[i + d + k - 1] - start[i + d] - expected) / max(expected, LEAST_LENGTH) + JOIN * (k - 1) + below[d + k - 1]
            better = cost < row[d]
            row[d[better]], took[d[better]] = cost[better], k
        for d in range(ahead - 1, -1, -1):
            if DROP + row[d + 1] < row[d]:
                row[d], took[d] = DROP + row[d + 1], 0
        choice[i], below = took, row
    out, d = [], 0
    for i in range(n):
        while choice[i, d] == 0:
            d += 1
        out.append((i + d, i + d + int(choice[i, d]) - 1))
        d += int(choice[i, d]) - 1
    return float(below[0]), out


def align(sizes: np.ndarray, start: np.ndarray, stop: np.ndarray, most: int = 3) -> list[tuple[int, int]]:
    """The first and last interval of each item; where intervals are fewer than items, the first ones one by one."""
    both = min(len(sizes), len(start))
    if not both or len(start) < len(sizes):
        return [(i, i) for i in range(both)]
    line = _line(sizes[:both], (stop - start)[:both])
    for _ in range(ROUNDS):
        _, found = cheapest(sizes, start, stop, line, most)
        line = _line(sizes, np.array([stop[b] - start[a] for a, b in found]))
    return found


def _aligned(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def settled(key: str | None, rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([r[1] for r in rows if r[0] == 0], float)
        start, stop = (np.array([r[i] for r in rows if r[0] == 1], float) for i in (2, 3))
        found = align(sizes, start, stop, most)
        taken = {j for a, b in found for j in range(a, b + 1)}
        out = [(key, i, a, b, start[a], stop[b]) for i, (a, b) in enumerate(found)]
        out += [(key, i, None, None, None, None) for i in range(len(found), len(sizes))]
        out += [(key, None, j, j, start[j], stop[j]) for j in range(len(start)) if j not in taken]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    key, rows = None, []
    for batch in batches:
        for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and name != key:
                yield settled(key, rows)
                rows = []
            key = name
            rows.append(tuple(row))
    if rows:
        yield settled(key, rows)


def aligned(items: DataFrame, intervals: DataFrame, most: int = 3) -> DataFrame:
    """(key, item, first, last, start, stop) of items (key, place, size) and intervals (key, start, stop).

    Items and intervals are numbered from 0 in order, by place and by start.  An interval that is left out has no item,
    an item without intervals no interval.
    """
    expected = items.select(F.col("key").cast("string").alias("key"), F.lit(0).alias("kind"), F.col("size").cast("double").alias("size"), F.col("place").cast("double").alias("start"), F.lit(None).cast("double").alias("stop"))
    heard = intervals.select(F.col("key").cast("string").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("size"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    ordered = expected.unionByName(heard).repartition("key").sortWithinPartitions("key", "kind", "start", "stop", "size")
    return ordered.mapInArrow(partial(_aligned, most=most), _ALIGNED)
