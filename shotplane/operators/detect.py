"""Relational parts of detection: cut-offs, overlap, suppression and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotplane.config import DetectConfig
from shotplane.functions.geometry import area, corners, inter, iou


def confidence(cls: Column, obj: Column) -> Column:
    """A detector's score: the geometric mean of two clamped confidences."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(clamp(cls) * clamp(obj))


def keep_detections(d: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Detections of an image (x, y, w, h, score) over the cut-off and not far narrower than the one of largest area: among
    equals the first in `id`, then the best scored, then the widest, whatever order rows come in."""
    main = Window.partitionBy("image").orderBy(F.desc(F.col("w") * F.col("h")), "id", F.desc("score"), F.desc("w"))
    return d.where(F.col("score") >= cfg.min_score).withColumn("_w", F.first("w").over(main)).where(F.col("w") >= F.col("_w") * cfg.min_width).drop("_w")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    x, y, w, h = (F.col(prefix + c) for c in "xywh")
    return x, y, x + w, y + h


def iou_pairs(d: DataFrame) -> DataFrame:
    """Overlapping pairs of an image's boxes, each once, with their IoU. An image has a few dozen boxes."""
    side = lambda s: d.select("image", *(F.col(c).alias(f"{s}{c}") for c in ("id", "x", "y", "w", "h")))
    return side("a_").join(side("b_"), "image").where("a_id < b_id").select("image", "a_id", "b_id", iou(box("a_"), box("b_")).alias("iou")).where("iou > 0")


def suppress(d: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Greedy suppression by image: boxes by falling score, then by `id`, a null last (among equals the first in x, y, w and h),
    each kept if its IoU with all kept ones is under max_iou. As in the SQL, a box with a null overlaps nothing, two boxes without
    area, whose IoU is no number, are not both kept, areas of negative sides count with their sign, and boxes of no image are
    left out. A fold over an image's array of boxes."""
    score = F.col("score").cast("double")
    # An array's order puts NaN last and null first.
    order = F.when(score.isNull(), float("nan")).when(F.isnan(score), float("-inf")).otherwise(-score)
    boxes = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("id").isNull().alias("no"), "id", *(F.col(c).cast("double").alias(c) for c in "xywh"))))
    sets = d.where("image is not null").groupBy("image").agg(boxes.alias("boxes"))

    def apart(k: Column, c: Column) -> Column:
        both = area(inter(*(corners(*(b[s] for s in "xywh")) for b in (k, c))))
        union = k["w"] * k["h"] + c["w"] * c["h"] - both
        return union.isNull() | F.coalesce(F.try_divide(both, union) < cfg.max_iou, F.lit(False))

    none = F.slice("boxes", 1, 0)
    kept = F.aggregate("boxes", none, lambda acc, c: F.when(F.forall(acc, lambda k: apart(k, c)), F.array_append(acc, c)).otherwise(acc))
    return sets.select("image", F.explode(F.transform(kept, lambda k: k["id"])).alias("id"))


def match(stored: DataFrame, fresh: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Stored faces with the fresh detection of their image that overlaps most (the last in `id` among equals), if over
    match_iou: image, id, fresh_id, iou. Without one, both are null."""
    f = fresh.select("image", *(F.col(c).alias(f"f_{c}") for c in ("id", "x", "y", "w", "h")))
    scored = stored.join(f, "image").withColumn("iou", iou(box(), box("f_"))).where(F.col("iou") > cfg.match_iou)
    best = scored.groupBy("image", "id").agg(F.max(F.struct("iou", "f_id")).alias("b")).select("image", "id", F.col("b.f_id").alias("fresh_id"), F.col("b.iou").alias("iou"))
    return stored.select("image", "id").join(best, ["image", "id"], "left")


def by_area(boxes: Column) -> Column:
    """An array of detections, largest first."""
    keyed = F.transform(boxes, lambda d, i: F.struct((-d["bbox"][2] * d["bbox"][3]).alias("o"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(a["i"] - b["i"])), lambda s: s["d"])
