"""Every registered query that has an SQL form, against DuckDB."""

import pytest

from compare import differences, duck
from tidewatt.catalog.all import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    ours = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = con.sql(ORACLES[name]).to_arrow_table()
    assert differences(ours, theirs) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    df = __spark_entry__.entry(spark)
    assert df.columns[:4] == ["event_type", "year", "quarter", "scenario"]
    assert df.count() > 0
