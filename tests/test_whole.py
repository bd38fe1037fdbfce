"""Queries do the whole job: every candidate, round, value and row, against brute force."""

import math
import os
from dataclasses import replace

import numpy as np
import pytest
from oracle import ROOT, connect
from pyspark.sql import functions as F

from shotplane.config import ReframeConfig
from shotplane.operators import calibrate, crops
from shotplane.plans import culling, exporting, framing, identity

SF = f"{ROOT}/{os.environ.get('TEST_SF', 'sf0.001')}"


def places(length, step):
    n = max(math.floor((1 - length) / step), 0)
    return [i * step for i in range(n + 1)] + [1 - length] * (1 - length - n * step > 1e-4)


def covered(tiles, x0, y0, x1, y1):
    """Sum of a grid over a rectangle, tile by tile by the share that is covered, and the rectangle's area in tiles."""
    rows, cols = tiles.shape
    down = np.clip(np.minimum(y1 * rows, np.arange(1, rows + 1)) - np.maximum(y0 * rows, np.arange(rows)), 0, 1)
    across = np.clip(np.minimum(x1 * cols, np.arange(1, cols + 1)) - np.maximum(x0 * cols, np.arange(cols)), 0, 1)
    return float(down @ tiles @ across), max((x1 - x0) * (y1 - y0) * rows * cols, 1e-6)


def slow_terms(box, s, sharp, luma, edge, cfg):
    """The terms of one crop as they are defined, by areas instead of prefix sums."""
    x, y, w, h = box
    mean = lambda g, *r: covered(g, *r)[0] / covered(g, *r)[1]
    f = s.faces[0]
    (l, t, fw, fhh), height, aspect = f["bbox"], f["chin"][1] - f["forehead"][1], s.height / s.width
    own = mean(sharp, l, t, l + fw, t + fhh)
    clutter = np.maximum((sharp - cfg.clutter * own) / max(own, 1e-3), 0)
    ex, ey = ((f["eyes"][0][k] + f["eyes"][1][k]) / 2 for k in (0, 1))
    fx = (ex - x) / w
    lead = abs(fx - 1 / 3) if f["yaw"] > cfg.yaw_turned else abs(fx - 2 / 3) if f["yaw"] < -cfg.yaw_turned else max(1 / 3 - fx, fx - 2 / 3, 0)
    cut = float(f["chin"][1] < y + h < f["chin"][1] + cfg.chin_band * height)
    pop = min(max(math.log2(own / max(mean(sharp, x, y, x + w, y + h), 1e-3)), 0), 1.5)
    reach = 1.5 * height * aspect
    body = max(x, ex - reach), max(y, t - cfg.margin[1] * height), min(x + w, ex + reach), min(y + h, 1.0)
    body_sum = covered(clutter, *body)[0] if body[2] > body[0] and body[3] > body[1] else 0
    clean = (covered(clutter, x, y, x + w, y + h)[0] - body_sum) / covered(clutter, x, y, x + w, y + h)[1]
    q, tw, th = range(cfg.segments), w * cfg.strip, h * cfg.strip
    bits = [(x + a * (w - tw), y + h * i / cfg.segments, x + a * (w - tw) + tw, y + h * (i + 1) / cfg.segments) for a in (0, 1) for i in q]
    bits += [(x + w * i / cfg.segments, y + a * (h - th), x + w * (i + 1) / cfg.segments, y + a * (h - th) + th) for a in (0, 1) for i in q]
    light = [mean(luma, *b) for b in bits]
    bright = max(max(light) - sum(light) / len(light) - cfg.bright_slack, 0)
    busy = min(max(max(mean(edge, *b) for b in bits) / (mean(edge, x, y, x + w, y + h) + 0.01) - 1, 0), 3)
    score = cfg.w_pop * pop - cfg.w_eyes * abs((ey - y) / h - 1 / 3) - cfg.w_lead * lead - cfg.w_cut * cut - cfg.w_bright * bright - cfg.w_busy * busy - cfg.w_clutter * clean
    return {"eyes": abs((ey - y) / h - 1 / 3), "lead": lead, "cut": cut, "score": score}


def test_suggestions_equal_a_search_by_hand(spark):
    """All sizes and places of a coarser step, scored one by one, taken one by one."""
    cfg = ReframeConfig(step=0.06, sizes=4)
    some = framing.scenes(spark, SF).where("scene in (1, 2, 3, 6)")
    g = framing.tiles(spark, SF).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("row", "col", "sharp", "luma", "edge"))).alias("g"))
    d = some.join(g, "scene").select("scene", "width", "height", "faces", F.lit(framing.COLS).alias("cols"), F.lit(framing.ROWS).alias("rows"), *(F.col(f"g.{k}").alias(k) for k in ("sharp", "luma", "edge")))
    got = {}
    for r in crops.suggest(d, cfg).orderBy("scene", "place").collect():
        got.setdefault(r.scene, []).append(r)
    allowed = framing.with_subject(crops.candidates(some, cfg)).where(crops.allowed(cfg)).collect()
    for s in d.collect():
        grid = [np.array(s[k]).reshape(framing.ROWS, framing.COLS) for k in ("sharp", "luma", "edge")]
        tried = [((r.x, r.y, r.w, r.h), (r.rn, r.rd), slow_terms((r.x, r.y, r.w, r.h), s, *grid, cfg)) for r in allowed if r.scene == s.scene]
        best = max(t["score"] for *_, t in tried)
        near = lambda k: max(min(t[k] for *_, t in tried) + cfg.gate, cfg.tolerance)  # noqa: B023, E731
        gated = [c for c in tried if c[2]["score"] >= best - cfg.slack and c[2]["eyes"] <= near("eyes") and c[2]["lead"] <= near("lead") and not c[2]["cut"]]
        *picks, whole = got[s.scene]
        assert (whole.x, whole.y, whole.w, whole.h, whole.notes[0]) == (0, 0, 1, 1, "original")
        score = {tuple(round(v, 9) for v in b): t["score"] for b, _, t in gated}
        for p in picks:
            assert abs(score[tuple(round(v, 9) for v in (p.x, p.y, p.w, p.h))] - p.score) < 1e-9
        left, taken = sorted(gated, key=lambda c: -c[2]["score"]), []
        for b, ratio, t in left:
            if len(taken) < cfg.total and sum(r == ratio for _, r, _ in taken) < cfg.per_ratio and all(overlap(b, o) < cfg.max_iou for o, *_ in taken):
                taken.append((b, ratio, t))
        assert [round(p.score, 9) for p in picks] == [round(t["score"], 9) for *_, t in taken]


def overlap(a, b):
    both = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0) * max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_a_frame_without_a_face_offers_only_itself(spark):
    schema = framing.scenes(spark, SF).schema
    d = spark.createDataFrame([(1, 6000, 4000, [])], schema).selectExpr("*", "1 cols", "1 rows", "array(1D) sharp", "array(0.5D) luma", "array(0.1D) edge")
    assert [(r.place, r.rn, r.rd, r.notes[0]) for r in crops.suggest(d).collect()] == [(0, 3, 2, "original")]


def test_a_bright_corner_costs(spark):
    dark, lit = np.full((43, 64), 0.3), np.full((43, 64), 0.3)
    lit[:4, :8] = 1.0
    prefix = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    box = np.array([[0.0, 0.0, 0.8, 0.8]])
    one, two = (crops.score_boxes(box, None, {"sharp": prefix(dark), "luma": prefix(v), "edge": prefix(dark), "clutter": prefix(dark)}, 0.0)["bright"][0] for v in (dark, lit))
    assert two > one == 0


def test_candidates_of_the_full_search_equal_brute_force(spark):
    cfg = ReframeConfig()
    some = framing.scenes(spark, SF).orderBy("scene").limit(4).collect()
    ids = [s.scene for s in some]
    got = {(r.scene, r.rn, r.rd, r.k): (r.n, r.sx, r.sy) for r in framing.crop_candidates(spark, SF).where(F.col("scene").isin(ids)).collect()}
    want = {}
    for s in some:
        for n, d in cfg.ratios:
            frame, v = s.width / s.height, n / d
            fw, fh = (1.0, frame / v) if v >= frame else (v / frame, 1.0)
            lo = max(cfg.min_scale, cfg.min_long / math.floor(max(fw * s.width, fh * s.height) + 0.5))
            if lo > 1:
                continue
            hi = max(cfg.max_scale, lo)
            many = cfg.sizes if hi > lo else 1
            for k in range(many):
                z = lo + (hi - lo) * k / max(many - 1, 1)
                z = min(1.0, z * 1.0005) if k == 0 and lo > cfg.min_scale else z
                xs, ys = places(fw * z, cfg.step), places(fh * z, cfg.step)
                want[s.scene, n, d, k] = (len(xs) * len(ys), sum(xs) * len(ys), sum(ys) * len(xs))
    assert got.keys() == want.keys() and max(k for *_, k in want) == cfg.sizes - 1
    for key, w in want.items():
        assert got[key][0] == w[0] and got[key][1:] == pytest.approx(w[1:], abs=1e-3)


def test_steps_and_tiles_of_the_settings(spark):
    lengths = {r.scene: r.px + 0.35 for r in framing.adapters.table(spark, SF, "scenes").collect()}
    got = {}
    for r in framing.crop_steps(spark, SF).orderBy("scene", "i").collect():
        got.setdefault(r.scene, []).append(r["at"])
    assert got.keys() == lengths.keys()
    for scene, n in lengths.items():
        assert got[scene] == pytest.approx(places(n, 0.015), abs=2e-6)
    long = framing.tile_spans(spark, SF).groupBy("scene").agg(F.max(F.greatest("row", "col")).alias("m")).select("m").distinct().collect()
    assert [r.m for r in long] == [63]


def test_calibration_goes_on_to_later_rounds(spark, monkeypatch):
    """A move of a later threshold lets an earlier one mend more, which one round would miss."""

    def sweep(shots, decisions, cfg, knob, values):
        tried = [replace(cfg, **{knob: v}) for v in values]
        return [3 if c.soft_rel == 0.5 else 2 if c.blink_closed == 0.45 else 1 for c in tried]

    monkeypatch.setattr(calibrate, "sweep", sweep)
    rows = {r.param: r for r in culling.calibrate_search(spark, SF).collect()}
    assert rows.keys() == {"blink_closed", "soft_rel"}
    assert {(r.errors_before, r.errors_after) for r in rows.values()} == {(3, 1)}


def test_sweep_tries_all_values(spark):
    got = {round(r.value, 3): r.errors for r in culling.knob_sweep(spark, SF).collect()}
    assert sorted(got) == [round(0.25 + 0.025 * k, 3) for k in range(23)]


def test_toggles_of_all_frames(spark):
    frames = culling.judged(spark, SF).select("folder", "file", "group_id", "decided").collect()
    groups = {}
    for r in frames:
        groups.setdefault((r.folder, r.group_id), []).append(r.decided == "reject")
    want = {(r.folder, r.file): ("none" if r.decided == "pick" else "pick", "none" if all(groups[r.folder, r.group_id]) else "reject") for r in frames}
    got = culling.mark_toggles(spark, SF).collect()
    assert len(got) == len(frames) and {(r.folder, r.file): (r.toggled, r.grouped) for r in got} == want


def test_a_group_is_toggled_by_all_its_frames(spark):
    d = spark.createDataFrame([("f", "1", 0, "reject"), ("f", "2", 0, "pick"), ("f", "3", 1, "reject")], "folder string, file string, group_id long, decided string")
    assert {r.file: r.grouped for r in culling.toggles(d, d).collect()} == {"1": "reject", "2": "reject", "3": "none"}
    assert {r.file: r.grouped for r in culling.toggles(d, d.where("file <> '2'")).collect()} == {"1": "none", "3": "none"}


def test_all_labels_are_learned_and_all_rolls_imported(spark):
    con = connect(SF)
    labels = {f"p{x}" for (x,) in con.execute("select distinct label from embeddings where label is not null").fetchall()}
    names = {r.name.lower() for r in identity.library_learn_cap(spark, SF).collect()}
    assert len(labels) > 4 and labels <= names
    want = con.execute("select lower('/p/' || n_name), '/p/' || n_name, c_name from nation join customer on n_nationkey = c_nationkey").fetchall()
    assert sorted(map(tuple, exporting.imported_files(spark, SF).select("folder", "roll", "file").collect())) == sorted(want)
