"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from monedero.plans import catalog
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) <= set(SQL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert difference(contract.queries()[name](spark, SF), con, SQL[name]) == ""


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["categoria", "prom_mensual", "actual_mes", "restante_estimado"]
    assert df.count() > 0
