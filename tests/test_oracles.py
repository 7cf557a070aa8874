"""Every registered query equals its DuckDB oracle on sf0.001 (rows, names, values)."""

import pytest

import __spark_entry__ as E
from leadflow import plans
from compare import duck, run_oracle, run_spark

KEYS = sorted(plans.queries())
ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_key_has_an_oracle():
    assert set(KEYS) == set(ORACLES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["investmenttypeid", "product_name", "bookings", "leads", "conversion_rate"]
    assert df.count() >= 0


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, sf, con, key):
    s_cols, s_rows = run_spark(E.queries()[key](spark, sf))
    o_cols, o_rows = run_oracle(con, ORACLES[key])
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows
