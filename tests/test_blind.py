import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seqlattice.operators import blind


def _order(spark, n, **how):
    rows = blind.blind_order(spark.createDataFrame([(f"w{i}",) for i in range(n)], "word string").repartition(3), **how).collect()
    return sorted(rows, key=lambda r: r.place)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), n=st.integers(0, 70), gap=st.integers(1, 25), share=st.sampled_from([0.0, 0.1, 0.5]), k=st.integers(0, 3))
def test_gaps_and_anchors_hold(spark, seed, n, gap, share, k):
    anchors = [(f"a{i}", 1 + 2 * i) for i in range(k) if 1 + 2 * i <= n + int(n * share) + k]
    rows = _order(spark, n, seed=seed, gap=gap, repeats=share, anchors=anchors) if not anchors or anchors[-1][1] <= n + len(anchors) else []
    if not rows:
        return
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    assert {(r.word, r.place) for r in rows if r.is_anchor} == set(anchors)
    first = {r.word: r.place for r in rows if not r.is_repeat}
    again = [r for r in rows if r.is_repeat]
    assert len(first) == n + len(anchors) and len({r.word for r in again}) == len(again) == min(int(n * share), max(0, n - gap + 1))
    assert all(r.place - first[r.word] >= gap for r in again)
    assert len({r.id for r in rows}) == len(first)


def test_orders_repeat_and_differ_by_seed(spark):
    one, same, other = ([r.word for r in _order(spark, 60, seed=s)] for s in (1, 1, 2))
    assert one == same != other and one != sorted(one)


def test_anchors_need_places(spark):
    for anchors in ([("a", 1), ("b", 1)], [("a", 0)], [("a", 99)]):
        with pytest.raises(ValueError):
            _order(spark, 10, anchors=anchors)
