"""Suppression on odd keys: nulls, and negative ones, which give boxes of no or negative sides."""

import pytest
from oracle import compare, connect
from shotplane import catalogue
from shotplane.operators import detect

COLUMNS = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int"
#: By case: what becomes of an image, a part and a supplier, by the number of the row. No boxes of an image tie.
ODD = {
    "no part": lambda i, o, p, s: (o, None if i % 7 == 0 else p, s),
    "no supplier": lambda i, o, p, s: (o, p, None if i % 7 == 0 else s),
    "no image": lambda i, o, p, s: (None if i < 5 else o, p, s),
    "no area": lambda i, o, p, s: (o, -40 - 260 * (i % 3) if i % 2 else p, s),
    "negative": lambda i, o, p, s: (o, (20, -100, p)[i % 3], (5, 5, -s)[i % 3]),
}


@pytest.mark.parametrize("case", ODD)
def test_suppression_of_odd_boxes_equals_sql(spark, tmp_path, case):
    rows = [(*ODD[case](i, i // 5, i * 7919 % 19997 + 1, i * 613 % 997 + 1), i % 5 + 1) for i in range(5000)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert compare(spark, connect(str(tmp_path)), catalogue.QUERIES["nms_keep"], catalogue.ORACLES["nms_keep"], str(tmp_path)) > 0


def test_suppression_without_score_or_id(spark):
    """Boxes that overlap: one without a score comes last, and so does one without an id among equals."""
    rows = [(1, 1, 0.0, 0.0, 9.0, 9.0, None), (1, 2, 0.0, 0.0, 9.0, 9.0, 0.1), (2, None, 0.0, 0.0, 9.0, 9.0, 0.5), (2, 3, 0.0, 0.0, 9.0, 9.0, 0.5)]
    got = detect.suppress(spark.createDataFrame(rows, "image int, id int, x double, y double, w double, h double, score double")).collect()
    assert sorted((r.image, r.id) for r in got) == [(1, 2), (2, 3)]
