"""Scored crops at any number of scenes: a scene is scored where it stands, in memory that does not grow with their number."""

import os

import numpy as np
import pytest
from oracle import ROOT
from shotplane import catalogue
from shotplane.operators import crops

SF = f"{ROOT}/{os.environ.get('TEST_SF', 'sf0.001')}"


@pytest.mark.parametrize("name", ["crop_notes", "crop_terms"])
def test_no_tile_is_gathered_or_joined(spark, name):
    """Tiles as rows had to be collected, sorted and joined again, which took more heap than a small driver has."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [s for s in ("Aggregate", "Join", "Sort", "Generate") if s in plan]


def test_scenes_of_one_batch(spark):
    """Grids of different sizes, more scenes than are handed on at once; a scene without a key or without crops has no row."""
    rng, n = np.random.default_rng(5), crops.SOME + 3
    grid = lambda k: [[float(v) for v in rng.random((2 + k % 3) * (3 + k % 2))] for _ in range(3)]
    box = lambda k: [(j, 0.1 * j, 0.2, 0.5, 0.3 + 0.1 * j) for j in range(k % 3 + 1)]
    rows = [(k, None, box(k), 3 + k % 2, 2 + k % 3, *grid(k)) for k in range(n)]
    rows += [(None, None, box(1), 3, 2, *grid(0)), (n, None, [], 3, 2, *grid(0))]
    kinds = "scene long, subj struct<yaw double>, crops array<struct<crop int, x double, y double, w double, h double>>, cols int, rows int, sharp array<double>, luma array<double>, edge array<double>"
    got = {(r.scene, r.crop): r for r in crops.crop_terms(spark.createDataFrame(rows, kinds).coalesce(1)).collect()}
    assert sorted(got) == [(k, j) for k in range(n) for j in range(k % 3 + 1)]
    for k, _, b, cols, lines, sharp, luma, edge in rows[:n]:
        sums, subj_sharp = crops.summed({"cols": cols, "rows": lines, "sharp": sharp, "luma": luma, "edge": edge}, None, crops.CFG)
        want = crops.score_boxes(np.array([c[1:] for c in b]), None, sums, subj_sharp)
        for j in range(len(b)):
            assert got[k, j].yaw is None or np.isnan(got[k, j].yaw)
            assert np.allclose([got[k, j][t] for t in crops.TERMS], want.iloc[j].to_numpy())
