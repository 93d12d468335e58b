import pytest

from seqlattice.plans import catalogue

from .compare import assert_same, connect

ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    assert_same(catalogue.queries()[name](spark, small), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rank_laws_events", "rank_laws_letters", "syllable_shapes", "join_forms", "word_ipa", "permutation_null_mi"])
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0
