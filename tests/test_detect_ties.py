"""Detections of an image that are equal in all that orders them: the result does not hang on the order of rows."""

from shotplane.operators import detect

COLUMNS = "image int, id int, x double, y double, w double, h double, score double"


def test_main_detection_of_equal_area_and_id(spark):
    """Two largest boxes of one area and id: the better scored one counts, else the wider one."""
    rows = [
        (1, 1, 0.0, 0.0, 200.0, 50.0, 0.7), (1, 1, 9.0, 9.0, 100.0, 100.0, 0.9), (1, 2, 0.0, 0.0, 30.0, 60.0, 0.8),
        (2, 1, 0.0, 0.0, 100.0, 100.0, 0.8), (2, 1, 9.0, 9.0, 200.0, 50.0, 0.8), (2, 2, 0.0, 0.0, 30.0, 60.0, 0.8),
    ]
    for some in (rows, rows[::-1]):
        got = detect.keep_detections(spark.createDataFrame(some, COLUMNS).coalesce(1)).collect()
        assert sorted((r.image, r.id, r.w) for r in got) == [(1, 1, 100.0), (1, 1, 200.0), (1, 2, 30.0), (2, 1, 100.0), (2, 1, 200.0)]


def test_suppression_of_equal_score_and_id(spark):
    """Boxes 6 are equal in score and id, and which of them comes first decides whether the first box 1 is kept: the SQL leaves
    it open, here the box whose sides come first does, whatever order rows come in."""
    rows = [
        (1, 7, 778.0, 11.0, 246.0, 249.0, 0.542), (1, 1, 660.0, 270.0, 100.0, 80.0, 0.34), (1, 1, 443.0, 143.0, 231.0, 117.0, 0.577), (1, 6, 453.0, 309.0, 221.0, 131.0, 0.567),
        (1, 6, 310.0, 91.0, 290.0, 169.0, 0.69), (1, 6, 310.0, 19.0, 290.0, 241.0, 0.69), (1, 7, 23.0, 265.0, 291.0, 55.0, 0.397), (1, 5, 303.0, 72.0, 251.0, 218.0, 0.117),
    ]
    for some in (rows, rows[::-1]):
        got = detect.suppress(spark.createDataFrame(some, COLUMNS).coalesce(1)).collect()
        assert sorted(r.id for r in got) == [1, 1, 6, 6, 7, 7]
