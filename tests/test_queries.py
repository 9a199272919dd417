"""Every registered query on the smallest tables, against its SQL twin where it has one."""

import __spark_entry__ as entry
import harness
import pytest

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns, rows = harness.spark_rows(df)
    if name not in ORACLES:
        assert rows
        return
    assert not harness.types(df, con, ORACLES[name])
    assert (columns, rows) == harness.duck_rows(con, ORACLES[name])
