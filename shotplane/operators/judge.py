"""Judging frames against their group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotplane.config import CullConfig
from shotplane.functions.faces import eyes_closed, usable
from shotplane.operators.group import ORDER

KEY = ("folder", "group_id")


def frame_rows(shots: DataFrame, cfg: CullConfig = CullConfig()) -> DataFrame:
    """Adds what judging needs of a frame, its worst usable face deciding: has_face, closed, sharp, smile, cut, and the
    reason without a usable face."""
    d = shots.withColumn("_fs", usable(F.col("faces"), cfg))
    some = F.size("_fs") > 0
    worst = lambda f: F.array_min(F.transform("_fs", f))
    why = F.when(F.size("faces") <= 0, "no-face").when(F.forall("faces", lambda f: f["presence"] < cfg.min_presence), "face-hidden").otherwise("small-face")
    return d.select(
        *shots.columns,
        some.alias("has_face"),
        (some & F.exists("_fs", lambda f: eyes_closed(f["blink"], cfg))).alias("closed"),
        F.when(some, worst(lambda f: F.greatest(f["eye_sharp"][0], f["eye_sharp"][1]))).otherwise(F.col("frame_sharp")).alias("sharp"),
        F.when(some, worst(lambda f: f["smile"])).otherwise(0.0).alias("smile"),
        (some & F.exists("_fs", lambda f: f["cut"])).alias("cut"),
        F.when(~some, why).alias("no_face_reason"),
    )


def verdicts(rows: DataFrame, cfg: CullConfig = CullConfig(), keys: tuple[str, ...] = KEY) -> DataFrame:
    """Adds rel_sharp, score, reasons and mark to frame_rows that have a group. keys name a group.

    Two window passes over one exchange by group: the group's best frames and counts, then the order of those that are
    not rejected. The smile's share of a score is not damped by closed eyes, and failed frames, alone in their groups,
    are picks; both are meant.
    """
    g = Window.partitionBy(*keys)
    best = lambda c: F.coalesce(F.max(F.when(c, F.greatest(F.col("sharp"), F.lit(0.0)))).over(g), F.lit(0.0))
    face = F.col("has_face")
    d = rows.withColumns({"best_face": best(face & ~F.col("closed")), "best_frame": best(~face), "n_face": F.sum(face.cast("int")).over(g), "n_frame": F.sum((~face).cast("int")).over(g)})
    top = F.when(face, F.col("best_face")).otherwise(F.col("best_frame"))
    d = d.withColumn("rel_sharp", F.when(top > 0, F.least(F.col("sharp") / top, F.lit(1.0))).otherwise(0.0))
    rel = F.col("rel_sharp")
    soft = face & (F.col("n_face") >= 2) & (F.col("best_face") > 0) & (rel < cfg.soft_rel)
    d = d.withColumn("rejected", F.col("closed") | soft)
    d = d.withColumn("score", F.when(face, rel * F.when(F.col("closed"), 0.3).otherwise(1.0) * F.when(F.col("cut"), 0.9).otherwise(1.0) + F.col("smile") * 0.05).otherwise(rel * 0.9))
    told = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array_compact(F.array(told(F.col("closed"), "eyes-closed"), told(soft, "soft-eyes"), told(F.col("cut"), "face-cut"), told(face & (F.col("smile") > cfg.smile), "smile"), F.col("no_face_reason"), told(~face & (F.col("n_frame") >= 2) & (rel < cfg.soft_frame), "soft-frame")))
    rank = Window.partitionBy(*keys, "rejected").orderBy(F.desc("score"), *ORDER)
    size = F.col("n_face") + F.col("n_frame")
    picks = F.lit(1) + sum(((size >= n).cast("int") for n in cfg.more_picks[1:]), (size >= cfg.more_picks[0]).cast("int"))
    d = d.withColumns({"_rank": F.row_number().over(rank), "_top": F.first("score").over(rank)})
    pick = ~F.col("rejected") & (F.col("_rank") <= picks) & (F.col("score") >= F.col("_top") * cfg.pick_ratio)
    sharpest = F.when(pick & (rel >= 0.999) & face, F.array(F.lit("sharpest"))).otherwise(F.array().cast("array<string>"))
    return d.select(*rows.columns, "rel_sharp", "score", F.concat(sharpest, reasons).alias("reasons"), F.when(F.col("rejected"), "reject").when(pick, "pick").otherwise("none").alias("mark"))


def judge(shots: DataFrame, cfg: CullConfig = CullConfig()) -> DataFrame:
    """Verdicts on grouped frames: their columns and rel_sharp, score, reasons, mark. `reasons` are in their fixed order."""
    d = verdicts(frame_rows(shots, cfg), cfg)
    return d.select(*shots.columns, "rel_sharp", "score", "reasons", "mark")


def effective(decided: Column, mark: Column) -> Column:
    """A user's decision, or else the verdict's mark."""
    return F.coalesce(decided, mark)
