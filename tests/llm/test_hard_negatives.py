import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.llm import hard_negatives

SCHEMA = "id long, label long, vector array<double>, block string, rank int"


def _vectors(spark, rows):
    named = spark.createDataFrame([(*r, "b", 7) for r in rows], SCHEMA)
    return hard_negatives.usable(named, F.col("id"), F.col("label"), F.col("vector"))


def _plain(rows, k=5):
    """Every row against every anchor, in whole numbers."""
    part = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in part:
        if i is None or i % 100:
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j, y) for j, y, w in part if j != i]
        by = lambda x: (-x[0], x[1] is None, x[1] or 0)
        for p, pid, _ in sorted((x for x in scored if x[2] == label), key=by)[:k]:
            found = sorted((x for x in scored if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=by)[:k]
            out += [(i, pid, r, j, p, n) for r, (n, j, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def _got(spark, rows):
    found = hard_negatives.hard_negatives(_vectors(spark, rows), F.col("id") % 100 == 0)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)


def test_equals_all_scores_over_many_blocks(spark, small_blocks):
    rng = random.Random(4)
    centers = [[rng.gauss(0, 1) for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(700):
        c, y = rng.choice(centers), rng.randint(0, 3)
        v = [x + rng.gauss(0, 0.7) for x in c]
        rows.append((i, y, [x / math.dist(v, [0] * 40) for x in v]))
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(120)]  # many copies of one vector
    got = _got(spark, rows)
    assert got == _plain(rows) and len(got) > 100


def test_defined_cases(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, 1, v), (1, 1, v), (2, 2, v), (3, None, v), (4, 2, None), (5, 2, [0.5, None, 1.0]), (6, 2, [0.5, float("nan"), 1.0]), (8, 1, [0.5, float("inf"), 1.0]), (9, 2, []), (10, 2, [0.5]), (None, 2, v), (None, 1, v),
        (0, 2, v), (100, 5, [0.0] * 3), (11, 5, [-1.0, 0.0, 0.0]), (12, 2, v), (12, 2, v), (200, 7, v), (13, 7, [-1.0, 0.0, -1.0]),
    ]
    got = _got(spark, rows)
    assert got == _plain(rows) and any(r[3] is None for r in got) and not any(r[0] == 200 for r in got)
    assert _got(spark, []) == []
    assert _got(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]


def test_scores_beyond_doubles(spark):
    rng = random.Random(8)
    for scale in (1e7, 1e30):
        rows = [(i, i % 2, [rng.uniform(0.5, 1) * scale for _ in range(6)]) for i in range(101)]
        assert _got(spark, rows) == _plain(rows)


@pytest.mark.parametrize("seed", range(6))
def test_the_index_loses_no_pair(seed):
    rng = np.random.default_rng(seed)
    rows = np.floor(rng.normal(size=(300, 50)) * rng.uniform(1, 60, 50))
    anchors = np.floor(rng.normal(size=(9, 50)) * rng.uniform(1, 60, 50))
    exact = anchors @ rows.T
    for least in (np.quantile(exact, 0.97, axis=1), np.zeros(9), np.full(9, -np.inf), np.quantile(exact, rng.uniform(0.2, 1, 9)[0], axis=1)):
        among = None if seed % 2 else np.sort(rng.choice(300, 140, replace=False))
        a, r, s = hard_negatives.Index(rows, 50).search(anchors, least, among)
        inside = np.isin(np.arange(300), among) if among is not None else np.ones(300, bool)
        assert sorted(zip(a, r)) == sorted(zip(*np.nonzero((exact >= least[:, None]) & inside))) and (exact[a, r] == s).all()
