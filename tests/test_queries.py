"""Every registered query against its SQL twin, and those without one for their schema."""

import pytest

from tests.comparing import assert_same
from weftgraph.plans import catalogue

WITHOUT = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(name, spark, small, duck):
    assert_same(spark, small, duck, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(name, spark, small):
    df = catalogue.QUERIES[name](spark, small)
    assert df.columns
    assert df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert "symbol_a" in entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
