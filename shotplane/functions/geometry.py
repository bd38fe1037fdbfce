"""Column functions on boxes, crops and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rectangle as its corners x0, y0, x1, y1.
Rect = tuple[Column, Column, Column, Column]


def corners(x: Column, y: Column, w: Column, h: Column) -> Rect:
    return x, y, x + w, y + h


def area(r: Rect) -> Column:
    """Area of corners; 0 if they are in the wrong order."""
    return F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))


def inter(a: Rect, b: Rect) -> Rect:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def inside(inner: Rect, outer: Rect) -> Column:
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    both = area(inter(a, b))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def crop_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A crop of fractions in whole pixels, kept inside the frame and at least one pixel wide and high."""
    px = F.least(F.round(x * width), width - 1).cast("long")
    py = F.least(F.round(y * height), height - 1).cast("long")
    pw = F.greatest(F.least(F.round(w * width).cast("long"), width.cast("long") - px), F.lit(1))
    ph = F.greatest(F.least(F.round(h * height).cast("long"), height.cast("long") - py), F.lit(1))
    return px, py, pw, ph


def long_side(w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.round(F.greatest(w * width, h * height)).cast("long")


def ratio_of(w: Column, h: Column) -> Column:
    """The ratio n:d with the smallest d up to 32 within half a percent, else the closest one: a struct (n, d)."""
    r = w / F.greatest(h, F.lit(1))
    tried = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda d: F.struct(F.abs(F.least(F.greatest(F.round(r * d), F.lit(1.0)), F.lit(255.0)) / d / r - 1).alias("err"), d.alias("d"), F.least(F.greatest(F.round(r * d), F.lit(1.0)), F.lit(255.0)).cast("int").alias("n")))
    near = F.filter(tried, lambda t: t["err"] < 0.005)
    best = F.when(F.size(near) > 0, near[0]).otherwise(F.array_min(tried))
    return F.struct(best["n"].alias("n"), best["d"].alias("d"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of positive whole numbers, by a Euclidean fold."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))))
    return done["a"]


def ratio_simplest(w: Column, h: Column) -> Column:
    """w:h in lowest terms; 3:2 or 2:3 where a part is over 32."""
    g = gcd(w, h)
    n, d = (w / g).cast("int"), (h / g).cast("int")
    usual = F.when(w >= h, F.struct(F.lit(3).alias("n"), F.lit(2).alias("d"))).otherwise(F.struct(F.lit(2).alias("n"), F.lit(3).alias("d")))
    return F.when((n > 32) | (d > 32), usual).otherwise(F.struct(n.alias("n"), d.alias("d")))


def similarity(points: list[tuple[Column, Column, Column, Column]]) -> tuple[Column, Column, Column, Column]:
    """The least-squares similarity (a, b, tx, ty) that takes points (x, y) to (u, v): u = ax - by + tx, v = bx + ay + ty;
    null if all points (x, y) are the same."""
    n = len(points)
    mean = [sum((p[k] for p in points[1:]), points[0][k]) / n for k in range(4)]
    c = [tuple(p[k] - mean[k] for k in range(4)) for p in points]
    add = lambda terms: sum(terms[1:], terms[0])
    size = add([x * x + y * y for x, y, _, _ in c])
    a = F.try_divide(add([x * u + y * v for x, y, u, v in c]), size)
    b = F.try_divide(add([x * v - y * u for x, y, u, v in c]), size)
    return a, b, mean[2] - a * mean[0] + b * mean[1], mean[3] - b * mean[0] - a * mean[1]


def landmark_roi(points: Column, left: int, right: int, grow: float = 1.5) -> Column:
    """A rotated square round landmarks (an array of [x, y, z]): struct (cx, cy, size, angle), the angle that of the line
    between two of them."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (F.greatest(x1 - x0, y1 - y0) * grow).alias("size"), F.atan2(points[right][1] - points[left][1], points[right][0] - points[left][0]).alias("angle"))


def roi_to_image(roi: Column, nx: Column, ny: Column) -> tuple[Column, Column]:
    """Where a point of a region of interest, in fractions of it, lies in the image."""
    dx, dy = (nx - 0.5) * roi["size"], (ny - 0.5) * roi["size"]
    c, s = F.cos(roi["angle"]), F.sin(roi["angle"])
    return roi["cx"] + dx * c - dy * s, roi["cy"] + dx * s + dy * c


def head(points: Column, width: Column, height: Column, marks: dict[str, int]) -> Column:
    """A face for cropping from landmarks in pixels, as fractions of the frame: bbox, eyes, chin, forehead and yaw.

    Yaw is how far the nose lies off the middle of the eyes' outer corners, along their line, in its length; so a rolled
    head does not read as a turned one.
    """
    xs, ys = F.transform(points, lambda p: p[0] / width), F.transform(points, lambda p: p[1] / height)
    x = lambda k: points[marks[k]][0]
    y = lambda k: points[marks[k]][1]
    ex, ey = x("l_outer") - x("r_outer"), y("l_outer") - y("r_outer")
    off = (x("nose") - (x("r_outer") + x("l_outer")) / 2) * ex + (y("nose") - (y("r_outer") + y("l_outer")) / 2) * ey
    eye = lambda k: F.array((x(f"{k}_outer") + x(f"{k}_inner")) / 2 / width, (y(f"{k}_outer") + y(f"{k}_inner")) / 2 / height)
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    at = lambda k: F.array(x(k) / width, y(k) / height)
    return F.struct(box.alias("bbox"), F.array(eye("r"), eye("l")).alias("eyes"), at("chin").alias("chin"), at("forehead").alias("forehead"), (off / F.greatest(ex * ex + ey * ey, F.lit(1.0))).alias("yaw"))
