"""Queries on scored crops at any number of scenes: grids stay on the executors."""

import os

import pytest
from oracle import ROOT
from shotplane import catalogue

SF = f"{ROOT}/{os.environ.get('TEST_SF', 'sf0.001')}"


@pytest.mark.parametrize("name", ["crop_gates", "crop_notes", "crop_terms"])
def test_no_grid_goes_through_the_driver(spark, name):
    """A broadcast is collected by the driver, and a plan takes exploded tiles for as few bytes as the scenes' table."""
    d = catalogue.QUERIES[name](spark, SF)
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() > 0
