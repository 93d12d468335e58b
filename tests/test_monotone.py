import datetime
from collections import Counter
from functools import cache

import numpy as np
import pytest

from seqlattice.operators import monotone
from seqlattice.plans import events


def _plain(sizes, start, stop, line, most):
    """The least cost over all ways, by trying each at every place."""
    @cache
    def rest(i, j):
        if i == len(sizes) and j == len(start):
            return 0.0
        ways = [1.5 + rest(i, j + 1)] if j < len(start) else []
        if i < len(sizes):
            expected = line[0] + line[1] * sizes[i]
            ways += [abs(stop[j + k - 1] - start[j] - expected) / max(expected, 0.1) + 0.25 * (k - 1) + rest(i + 1, j + k) for k in range(1, most + 1) if j + k <= len(start)]
        return min(ways, default=float("inf"))

    return rest(0, 0)


def _cost(sizes, start, stop, line, pairs):
    taken = sum(b - a + 1 for a, b in pairs)
    assert [a for a, _ in pairs] == sorted(a for a, _ in pairs) and all(b < a for (_, b), (a, _) in zip(pairs, pairs[1:], strict=False))
    return sum(abs(stop[b] - start[a] - (e := line[0] + line[1] * s)) / max(e, 0.1) + 0.25 * (b - a) for s, (a, b) in zip(sizes, pairs, strict=True)) + 1.5 * (len(start) - taken)


@pytest.mark.parametrize("seed", range(8))
def test_costs_equal_those_of_all_ways(seed):
    rng = np.random.default_rng(seed)
    for _ in range(12):
        n = int(rng.integers(1, 9))
        m = n + int(rng.integers(0, 9))
        sizes = rng.integers(1, 6, n).astype(float)
        start = np.cumsum(rng.uniform(0.3, 3, m))
        stop = start + rng.uniform(0.1, 2, m)
        for most in (1, 3):
            cost, pairs = monotone.cheapest(sizes, start, stop, (0.4, 0.3), most)
            assert cost == pytest.approx(_plain(tuple(sizes), tuple(start), tuple(stop), (0.4, 0.3), most))
            assert cost == pytest.approx(_cost(sizes, start, stop, (0.4, 0.3), pairs))


def test_split_and_extra_utterances_are_found():
    rng = np.random.default_rng(3)
    sizes = rng.integers(2, 6, 40).astype(float)
    spans, expected, t = [], [], 0.0
    for i, s in enumerate(sizes):
        length = 0.5 + 0.4 * s
        if i % 11 == 5:  # a cough of no such length
            spans.append((t, t + 9))
            t += 12
        expected.append((len(spans), len(spans) + (i % 7 == 3)))
        spans += [(t, t + 0.45 * length), (t + 0.55 * length, t + length)] if i % 7 == 3 else [(t, t + length)]
        t += length + 3
    start, stop = np.array(spans).T
    assert monotone.align(sizes, start, stop) == expected


def test_keys_are_aligned_apart(spark):
    items = spark.createDataFrame([("a", i, 2) for i in range(3)] + [("b", 0, 1), ("b", 1, 1), ("c", 0, 1), (None, 0, 1)], "key string, place int, size int")
    heard = spark.createDataFrame([("a", float(i), i + 0.5) for i in range(4)] + [("b", 1.0, 2.0), ("d", 1.0, 2.0), (None, 0.0, 1.0)], "key string, start double, stop double")
    got = monotone.aligned(items, heard)
    rows = {(r.key, r.item, r.first, r.last) for r in got.collect()}
    pairs = monotone.align(np.array([2.0] * 3), np.arange(4.0), np.arange(4.0) + 0.5)
    assert {r for r in rows if r[0] == "a" and r[1] is not None} == {("a", i, *p) for i, p in enumerate(pairs)}
    assert {r for r in rows if r[0] != "a"} == {("b", 0, 0, 0), ("b", 1, None, None), ("c", 0, None, None), ("d", None, 0, 0), (None, 0, 0, 0)}
    assert monotone.aligned(items.limit(0), heard.limit(0)).count() == 0


def test_query_equals_one_user_after_the_other(spark, small):
    rows = sorted(spark.read.parquet(f"{small}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id))
    expected = Counter()
    places = Counter()
    for user in {r.user_id for r in rows}:
        mine = [(r.event_type, r.value or 0.0, r.ts) for r in rows if r.user_id == user]
        sizes = np.array([1 + int(abs(v)) % 5 for kind, v, _ in mine if kind == "purchase"], float)
        spans = [(round(t.replace(tzinfo=datetime.UTC).timestamp() * 1e6) / 6e8, abs(v)) for kind, v, t in mine if kind in ("view", "click")]
        start = np.array([a for a, _ in spans])
        stop = np.array([a + v / 100 for a, v in spans])
        found = monotone.align(sizes, start, stop)
        taken = {j for a, b in found for j in range(a, b + 1)}
        for a, b in found:
            expected[str(user), b - a + 1] += 1
            places[str(user), b - a + 1] += a
        for j in range(len(spans)):
            if j not in taken:
                expected[str(user), 0] += 1
                places[str(user), 0] += j
        for _ in range(len(sizes) - len(found)):
            expected[str(user), -1] += 1
    got = events.utterance_alignment(spark, small).collect()
    assert {(r.key, r.took): r.n for r in got} == dict(expected)
    assert {(r.key, r.took): r.places or 0 for r in got} == {k: places[k] for k in expected}
