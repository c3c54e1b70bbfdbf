"""Registered queries against their SQL, and the guard of the entry point."""

import pytest

import __spark_entry__
from compare import differences, duck
from tidewatt.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR).toArrow(), con.sql(ORACLES[name]).to_arrow_table()) == []


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
