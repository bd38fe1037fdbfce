"""Column functions on measured faces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotplane.config import CullConfig


def eye_state(blink: Column, cfg: CullConfig = CullConfig()) -> Column:
    return F.when(blink >= cfg.blink_closed, "closed").when(blink >= cfg.blink_both, "half").otherwise("open")


def eyes_closed(blink: Column, cfg: CullConfig = CullConfig()) -> Column:
    """One eye closed, and the other at least half."""
    return (F.greatest(blink[0], blink[1]) >= cfg.blink_closed) & (F.least(blink[0], blink[1]) >= cfg.blink_both)


def usable(faces: Column, cfg: CullConfig = CullConfig()) -> Column:
    """Faces that are present and have an eye of enough pixels."""
    return F.filter(faces, lambda f: (f["presence"] >= cfg.min_presence) & (F.greatest(f["eye_px"][0], f["eye_px"][1]) >= cfg.min_eye_px))


def face_dist(a: Column, aw: Column, ah: Column, b: Column, bw: Column, bh: Column) -> Column:
    """How far the main face moved between two frames: shift of its centre in frames, plus the log of its change in
    width. a and b are its boxes; null if either is."""
    shift = F.abs((a[0] + a[2] / 2) / aw - (b[0] + b[2] / 2) / bw) + F.abs((a[1] + a[3] / 2) / ah - (b[1] + b[3] / 2) / bh)
    return shift + F.abs(F.log(F.greatest(a[2], F.lit(1.0)) / F.greatest(b[2], F.lit(1.0))))


def measures(points: Column, width: Column, height: Column, marks: dict[str, int]) -> dict[str, Column]:
    """Geometry of a face from landmarks in pixels: widths of the eyes, opening over width, whether the frame cuts the
    face (by 3 % of its width), its inner box (the middle 60 %), boxes of the eyes, and a strip round both with 15 % to
    spare."""
    x = lambda k: points[marks[k]][0]
    y = lambda k: points[marks[k]][1]
    d = lambda a, b: F.sqrt(F.pow(x(a) - x(b), 2) + F.pow(y(a) - y(b), 2))
    wide = {k: F.greatest(d(f"{k}_outer", f"{k}_inner"), F.lit(1.0)) for k in "rl"}
    boxes = {k: ((x(f"{k}_outer") + x(f"{k}_inner")) / 2 - wide[k] * 0.9, (y(f"{k}_outer") + y(f"{k}_inner")) / 2 - wide[k] * 0.55, wide[k] * 1.8, wide[k] * 1.1) for k in "rl"}
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    slack = (x1 - x0) * 0.03
    r, left = boxes["r"], boxes["l"]
    sx0, sy0 = F.least(r[0], left[0]), F.least(r[1], left[1])
    sx1, sy1 = F.greatest(r[0] + r[2], left[0] + left[2]), F.greatest(r[1] + r[3], left[1] + left[3])
    pad = (sx1 - sx0) * 0.15
    return {
        "eye_px": F.array(wide["r"], wide["l"]),
        "ear": F.array(*(d(f"{k}_up", f"{k}_down") / wide[k] for k in "rl")),
        "cut": (x0 < -slack) | (y0 < -slack) | (x1 > width + slack) | (y1 > height + slack),
        "inner_box": F.array(x0 + (x1 - x0) * 0.2, y0 + (y1 - y0) * 0.2, (x1 - x0) * 0.6, (y1 - y0) * 0.6),
        "eye_boxes": F.array(F.array(*r), F.array(*left)),
        "eyes_box": F.array(sx0 - pad, sy0 - pad, sx1 - sx0 + pad * 2, sy1 - sy0 + pad * 2),
    }
