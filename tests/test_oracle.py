"""Every registered query against its SQL, on whole test tables."""

import os

import pytest

import __spark_entry__ as contract
from checks import ORACLE, QUERIES
from checks.compare import compare, connect

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    with connect(SF_DIR) as c:
        yield c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["cadastral_num", "realty_type_bkh", "region_code", "create_dt"]
    assert rows.count() > 0
