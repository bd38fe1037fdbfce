"""Image kernels: on pixel or tile rows by windows, on arrays by numpy, and a hook for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least spread of a tile that is measured, and grey level from which a pixel is clipped.
FLAT, CLIP = 6.0, 250
#: Tiles along a frame's long side.
TILES = 64


def laplacian(cells: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """The four-neighbour Laplacian of inner cells (keys, row, col, v): a cell whose four neighbours are there."""
    row, col = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")
    d = cells.withColumns({"_l": F.lag("v").over(row), "_r": F.lead("v").over(row), "_u": F.lag("v").over(col), "_d": F.lead("v").over(col)})
    return d.withColumn("lap", F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") - F.col("v") * 4).drop("_l", "_r", "_u", "_d")


def sharpness_of(cells: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Sharpness by image: root mean square of the Laplacian over the spread plus 4; 0 where a side is under 5."""
    d = laplacian(cells, keys).groupBy(*keys).agg(F.sqrt(F.avg(F.col("lap") * F.col("lap"))).alias("rms"), F.stddev_pop("v").alias("sd"), F.count_distinct("row").alias("h"), F.count_distinct("col").alias("w"))
    return d.select(*keys, F.when((F.col("w") < 5) | (F.col("h") < 5), 0.0).otherwise(F.col("rms") / (F.col("sd") + 4.0)).alias("sharpness"))


def levels_of(cells: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Mean grey, share of clipped cells and spread."""
    return cells.groupBy(*keys).agg(F.avg("v").alias("luma"), (F.count_if(F.col("v") >= CLIP) / F.count("*")).alias("clip"), F.stddev_pop("v").alias("spread"))


def gradient(cells: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Half the sum of both central differences at each cell, whole and up to 255; edge cells stand for their missing
    neighbours."""
    row, col = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")
    side = lambda f, w: F.coalesce(f("v").over(w), F.col("v"))
    dx, dy = side(F.lead, row) - side(F.lag, row), side(F.lead, col) - side(F.lag, col)
    return cells.withColumn("grad", F.least(F.floor((F.abs(dx) + F.abs(dy)) / 2).cast("double"), F.lit(255.0)))


def tile_grid(frames: DataFrame, tiles: int = TILES) -> DataFrame:
    """Whole-number spans of a frame's tiles, `tiles` along its long side: scene, row, col, x0, y0, x1, y1."""
    long = F.greatest("width", "height")
    n = lambda side: F.greatest(F.round(F.col(side) * tiles / long), F.lit(1.0)).cast("int")
    d = frames.select("scene", "width", "height", n("width").alias("cols"), n("height").alias("rows"))
    d = d.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    cut = lambda k, n_, side: F.floor(k * F.col(side) / F.col(n_)).cast("int")
    return d.select("scene", "row", "col", cut(F.col("col"), "cols", "width").alias("x0"), cut(F.col("row"), "rows", "height").alias("y0"), cut(F.col("col") + 1, "cols", "width").alias("x1"), cut(F.col("row") + 1, "rows", "height").alias("y1"))


def frame_sharpness(tiles: DataFrame, keys: tuple[str, ...] = ("scene",), share: float = 0.9) -> DataFrame:
    """A frame's sharpness: of its tiles (sharp, spread) that are not flat, the one at index floor(share * n) in order; 0
    without any."""
    w = Window.partitionBy(*keys).orderBy("sharp", "row", "col")
    d = tiles.withColumn("_ok", F.col("spread") > FLAT)
    ranked = d.where("_ok").withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    at = ranked.where(F.col("_i") == F.floor(F.col("_n") * F.lit(share))).select(*keys, F.col("sharp").alias("frame_sharp"))
    return d.select(*keys).distinct().join(at, list(keys), "left").withColumn("frame_sharp", F.coalesce("frame_sharp", F.lit(0.0)))


# ---- arrays -----------------------------------------------------------------------------------------------------


def np_sharpness(v: np.ndarray) -> float:
    if min(v.shape) < 5:
        return 0.0
    v = v.astype(np.float64)
    lap = v[1:-1, :-2] + v[1:-1, 2:] + v[:-2, 1:-1] + v[2:, 1:-1] - 4 * v[1:-1, 1:-1]
    return float(np.sqrt((lap**2).mean()) / (v.std() + 4))


def np_gradient(v: np.ndarray) -> np.ndarray:
    """gradient() of an array."""
    p = np.pad(v.astype(np.float64), 1, mode="edge")
    return np.minimum((np.abs(p[1:-1, 2:] - p[1:-1, :-2]) + np.abs(p[2:, 1:-1] - p[:-2, 1:-1])) // 2, 255.0)


def np_grey(v: np.ndarray) -> np.ndarray:
    """Whole grey levels of an image by the weights of its colours."""
    return np.round(v.astype(np.float64) @ [0.2126, 0.7152, 0.0722]) if v.ndim == 3 else v.astype(np.float64)


def np_tiles(v: np.ndarray, tiles: int = TILES) -> dict[str, np.ndarray]:
    """Tiles of an image, `tiles` along its long side, as rows by columns: sharp (0 where a tile is flat) and luma (0 to 1) of
    a copy of half its size, and edge (0 to 1), the mean gradient of one of a quarter."""
    h, w = v.shape[:2]
    cols, rows = (max(int(np.floor(n * tiles / max(h, w) + 0.5)), 1) for n in (w, h))
    half, quarter = (np.round(np_resize(np_grey(v), max(h // k, 1), max(w // k, 1))) for k in (2, 4))
    grad = np_gradient(quarter)
    out = {k: np.zeros((rows, cols)) for k in ("sharp", "luma", "edge")}
    spans = lambda n, size: [(k * size // n, (k + 1) * size // n) for k in range(n)]
    for r, ((y0, y1), (v0, v1)) in enumerate(zip(spans(rows, half.shape[0]), spans(rows, grad.shape[0]))):
        for c, ((x0, x1), (u0, u1)) in enumerate(zip(spans(cols, half.shape[1]), spans(cols, grad.shape[1]))):
            t, g = half[y0:y1, x0:x1], grad[v0:v1, u0:u1]
            out["sharp"][r, c] = np_sharpness(t) if t.size and t.std() > FLAT else 0.0
            out["luma"][r, c] = t.mean() / 255 if t.size else 0.0
            out["edge"][r, c] = g.mean() / 255 if g.size else 0.0
    return out


def np_grey_crop(v: np.ndarray, box: tuple[float, float, float, float], scale: float) -> np.ndarray:
    """The grey part of an image under a box (x, y, w, h in pixels, held to the image), scaled but never enlarged."""
    h, w = v.shape[:2]
    x0, y0 = np.clip(box[0], 0, w - 1), np.clip(box[1], 0, h - 1)
    x1, y1 = np.clip(box[0] + box[2], x0 + 1, w), np.clip(box[1] + box[3], y0 + 1, h)
    part = np_grey(v[int(y0) : int(y0) + int(y1 - y0), int(x0) : int(x0) + int(x1 - x0)])
    sides = (max(int(np.floor(n * scale + 0.5)), 1) for n in (y1 - y0, x1 - x0))
    return np_resize(part, *sides) if scale < 1 else part


def tiles_column(height: Column, width: Column, pixels: Column, tiles: int = TILES) -> Column:
    """np_tiles of row-major grey pixels: cols, rows, and sharp, luma and edge as row-major arrays."""

    @F.pandas_udf("cols int, rows int, sharp array<double>, luma array<double>, edge array<double>")
    def measure(h: pd.Series, w: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, x in zip(h, w, v):
            t = np_tiles(np.asarray(x, float).reshape(int(a), int(b)), tiles)
            out.append((t["sharp"].shape[1], t["sharp"].shape[0], *(t[k].ravel().tolist() for k in ("sharp", "luma", "edge"))))
        return pd.DataFrame(out, columns=["cols", "rows", "sharp", "luma", "edge"])

    return measure(height, width, pixels)


def np_resize(v: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resizes by area on the way down and by lines on the way up."""
    for axis, n in ((0, height), (1, width)):
        old = v.shape[axis]
        scale = max(old / n, 1.0)
        centre = (np.arange(n) + 0.5) * old / n - 0.5
        weight = np.maximum(1 - np.abs((np.arange(old)[None] - centre[:, None]) / scale), 0)
        weight /= weight.sum(1, keepdims=True)
        v = np.moveaxis(np.tensordot(weight, v.astype(np.float64), (1, axis)), 0, axis)
    return v


def np_fit(v: np.ndarray, long: int) -> np.ndarray:
    """Fits an image into a square without enlarging it."""
    h, w = v.shape[:2]
    k = min(1.0, long / max(h, w))
    return v if k == 1 else np_resize(v, max(round(h * k), 1), max(round(w * k), 1))


def np_signature(grey: np.ndarray, side: int = 16) -> np.ndarray:
    """A small grey signature with its levels stretched."""
    g = np_resize(grey, side, side).round().astype(int).ravel()
    lo, hi = g.min(), g.max()
    return (g - lo) * 255 // max(hi - lo, 1)


def np_lift(v: np.ndarray) -> np.ndarray:
    """Brightens a dark image: the 99.5th percentile goes to 235 by a gain of 1 to 8, then mid tones by a power."""
    top = max(float(np.percentile(v, 99.5)), 1.0)
    g = np.clip(v * min(max(235.0 / top, 1.0), 8.0), 0, 255) / 255
    mid = min(max(float(g.mean()), 1e-3), 0.999)
    power = min(max(np.log(0.45) / np.log(mid), 0.35), 1.0)
    return (255 * g**power).round().clip(0, 255)


def np_bilinear(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at points; outside the image nothing, 0."""
    h, w = v.shape[:2]
    ok = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    i, j = np.clip(np.floor(x).astype(int), 0, max(w - 2, 0)), np.clip(np.floor(y).astype(int), 0, max(h - 2, 0))
    fx, fy = np.clip(x - i, 0, 1), np.clip(y - j, 0, 1)
    i1, j1 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    shape = (...,) + (None,) * (v.ndim - 2)
    fx, fy, ok = fx[shape], fy[shape], ok[shape]
    got = (v[j, i] * (1 - fx) + v[j, i1] * fx) * (1 - fy) + (v[j1, i] * (1 - fx) + v[j1, i1] * fx) * fy
    return np.where(ok, got, 0.0)


def np_warp(v: np.ndarray, cx: float, cy: float, size: float, angle: float, side: int) -> np.ndarray:
    """A rotated square of an image as a side x side image."""
    u = (np.arange(side) + 0.5) / side - 0.5
    dx, dy = np.meshgrid(u * size, u * size)
    c, s = np.cos(angle), np.sin(angle)
    return np_bilinear(v, cx + dx * c - dy * s - 0.5, cy + dx * s + dy * c - 0.5)


def np_similarity(src: np.ndarray, dst: np.ndarray) -> tuple[float, float, float, float]:
    """The least-squares similarity (a, b, tx, ty) from points to points."""
    p, q = src - src.mean(0), dst - dst.mean(0)
    size = (p**2).sum()
    a, b = (p * q).sum() / size, (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum() / size
    t = dst.mean(0) - np.array([a * src[:, 0].mean() - b * src[:, 1].mean(), b * src[:, 0].mean() + a * src[:, 1].mean()])
    return float(a), float(b), float(t[0]), float(t[1])


def np_align(v: np.ndarray, points: np.ndarray, template: np.ndarray, side: int = 112) -> np.ndarray:
    """An image moved so that points lie on a template's."""
    a, b, tx, ty = np_similarity(template, points)
    x, y = np.meshgrid(np.arange(side, dtype=float), np.arange(side, dtype=float))
    return np_bilinear(v, a * x - b * y + tx, b * x + a * y + ty)


def signature_column(height: Column, width: Column, pixels: Column) -> Column:
    """A signature from row-major grey pixels."""

    @F.pandas_udf("array<int>")
    def sign(h: pd.Series, w: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([np_signature(np.asarray(x, float).reshape(int(a), int(b))).tolist() for a, b, x in zip(h, w, v)])

    return sign(height, width, pixels)


class Models:
    """What analysis needs of neural models; weights are a user's own.

    `detect(pixels) -> list of dicts` (bbox, score, kps), `mesh(pixels, detection) -> dict`, `embed(pixels, detection) ->
    (vector, norm)`. A factory makes one in each Python worker.
    """

    def detect(self, pixels: np.ndarray) -> list[dict]:
        raise NotImplementedError

    def mesh(self, pixels: np.ndarray, detection: dict) -> dict:
        raise NotImplementedError

    def embed(self, pixels: np.ndarray, detection: dict) -> tuple[list[float], float]:
        raise NotImplementedError


_MODELS: dict[str, Models] = {}
ANALYSED = "folder string, file string, width int, height int, n_faces int, embeds array<array<double>>, frame_sharp double, sig array<int>, error string"


def analyse(images: DataFrame, factory: Callable[[], Models], decode: Callable[[bytes], np.ndarray], min_width: float = 0.25) -> DataFrame:
    """Analyses files (folder, file, content) by a model: one row a file, a failed one with its error and nothing else.

    Load, detection, measuring and identity are one pass over a file's pixels, so pixels never leave the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = f"{factory.__module__}.{factory.__qualname__}"
        model = _MODELS.setdefault(key, None) or factory()
        _MODELS[key] = model
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    px = decode(r.content)
                    grey = px.mean(2) if px.ndim == 3 else px
                    found = sorted(model.detect(px), key=lambda d: -d["bbox"][2] * d["bbox"][3])
                    found = [d for d in found if d["bbox"][2] >= min_width * found[0]["bbox"][2]]
                    embeds = [list(map(float, model.embed(px, d)[0])) for d in found]
                    out.append((r.folder, r.file, px.shape[1], px.shape[0], len(found), embeds, np_sharpness(grey), np_signature(grey).tolist(), None))
                except Exception as e:  # noqa: BLE001 - a file's failure is a row
                    out.append((r.folder, r.file, 0, 0, 0, [], 0.0, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANALYSED.split(", ")])

    return images.select("folder", "file", "content").mapInPandas(run, ANALYSED)
