import pytest
from oracle import ROOT, compare, connect
from shotplane.llm import queries

SF = f"{ROOT}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_returns_a_row_for_each_input(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() >= n
