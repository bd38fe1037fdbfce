import os

import pytest
from oracle import ROOT, compare, connect
from shotplane import catalogue

SF = f"{ROOT}/{os.environ.get('TEST_SF', 'sf0.001')}"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) >= 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
