"""Scored crops as columns: no Python worker beside the JVM, and the same terms as by array arithmetic."""

import os

import numpy as np
import pytest
from oracle import ROOT
from pyspark.sql import functions as F
from shotplane import catalogue
from shotplane.operators import crops

SF = f"{ROOT}/{os.environ.get('TEST_SF', 'sf0.001')}"


@pytest.mark.parametrize("name", ["crop_gates", "crop_notes", "crop_terms"])
def test_no_python_worker_holds_grids(spark, name):
    """Where executors are threads of the driver, workers and their Arrow batches are of the driver's memory, too."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [s for s in ("InPandas", "InArrow", "EvalPython") if s in plan]


def test_terms_as_a_column(spark):
    """Grids of different sizes, crops over the frame's edge, scenes with and without a subject, or without crops."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        lines, cols = 2 + k % 3, 3 + k % 4
        x, y = (float(v) for v in rng.random(2) * 0.4 + 0.2)
        subj = None if k % 4 == 3 else ([x - 0.1, y - 0.1, x + 0.3, y + 0.3], [x + 0.05, y + 0.06], y + 0.2, 0.2, (k % 3 - 1) * 0.2, [x - 0.2, y - 0.05, x + 0.3, 1.0], [x, y, x + 0.12, y + 0.18])
        boxes = [(j, *(float(v) for v in (*rng.random(2) * 0.5 - 0.1, *rng.random(2) * 0.6 + 0.2))) for j in range(k % 5)]
        rows.append((k, subj, boxes, cols, lines, *([float(v) for v in rng.random(cols * lines)] for _ in range(3))))
    subj = "struct<keep array<double>, eye array<double>, chin double, height double, yaw double, figure array<double>, box array<double>>"
    d = spark.createDataFrame(rows, f"scene long, subj {subj}, crops array<struct<crop int, x double, y double, w double, h double>>, cols int, rows int, sharp array<double>, luma array<double>, edge array<double>")
    c = F.col
    got = d.select("scene", crops.terms_column(c("subj"), c("crops"), c("cols"), c("rows"), c("sharp"), c("luma"), c("edge")).alias("t"))
    want = {(r.scene, r.crop): r for r in crops.crop_terms(d).collect()}
    seen = {(r.scene, t.crop): t for r in got.collect() for t in r.t}
    assert sorted(seen) == sorted(want) and len(want) == sum(k % 5 for k in range(12))
    for at, t in seen.items():
        assert np.allclose([t[k] for k in crops.TERMS], [want[at][k] for k in crops.TERMS], atol=1e-9), (at, t, want[at])
