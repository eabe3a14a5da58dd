"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from conftest import DATA, same_rows
from framewright.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(name, spark, duck):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert all(kind != "void" for _, kind in df.dtypes)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
