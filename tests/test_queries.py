import pytest

from compare import oracle, result
from larkspar.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got, want = result(df), oracle(ORACLES[name], sf)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_and_optional_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
