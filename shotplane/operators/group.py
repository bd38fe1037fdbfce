"""Sessions of consecutive similar frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotplane.config import CullConfig
from shotplane.functions.faces import face_dist
from shotplane.functions.vectors import sig_dist

#: Capture order within a folder.
ORDER = ("time", "file")
#: Seconds of a stretch, by which a folder's frames are dealt.
STRETCH = 86400.0


def in_order(folder: str = "folder") -> Window:
    return Window.partitionBy(folder).orderBy(*ORDER)


def compared(shots: DataFrame, cfg: CullConfig) -> Column:
    """What grouping compares of a frame, in capture order: a struct of time, file and, where they are there, sides,
    signature and main face's box."""
    have = set(shots.columns)
    parts = [F.col("time").alias("time"), F.col("file").alias("file")]
    if {"width", "height"} <= have:
        parts += [F.col("width").alias("width"), F.col("height").alias("height")]
    if "sig" in have:
        parts.append(F.col("sig").alias("sig"))
        if "faces" in have:
            parts.append(F.get(F.col("faces"), F.lit(0))["bbox"].alias("box"))
    return F.struct(*parts)


def begins(now: Column, before: Column, shots: DataFrame, cfg: CullConfig = CullConfig()) -> Column:
    """Whether a frame starts a group, from what is compared of it and of the frame before it: it is its folder's first,
    comes over scene_gap later, is wide where that was tall, or differs by over split_dist in signature and main face."""
    have = set(shots.columns)
    new = before.isNull() | (now["time"] - before["time"] > cfg.scene_gap)
    sides = {"width", "height"} <= have
    if cfg.orientation_break and sides:
        new |= (now["width"] > now["height"]) != (before["width"] > before["height"])
    if "sig" in have:
        dist = sig_dist(now["sig"], before["sig"])
        if "faces" in have and sides:
            shift = face_dist(now["box"], now["width"], now["height"], before["box"], before["width"], before["height"])
            dist = dist + F.coalesce(shift, F.lit(0.0)) * cfg.face_weight
        new |= dist > cfg.split_dist
    return F.coalesce(new, F.lit(False)).cast("int")


def numbered(shots: DataFrame, now: Column, begins: Callable[[Column, Column], Column], stretch: float = STRETCH) -> DataFrame:
    """Adds group_id, from 0 in each folder's capture order: the number of frames up to a frame that begin a group, less one.

    begins(now, before) tells, as 0 or 1, whether a frame begins one, from `now` (a struct that starts with time and file) of
    it and of the frame before; without one it is 1. No folder is ordered in one task: frames are dealt by folder and
    stretch of time, a day unless told otherwise, and ordered there. One row a stretch, with its first and last frame, is
    ordered by folder; it tells whether the first begins a group, and how many began before. Frames without a time come
    first.
    """
    n, at, inner, run, head = "_now", "_at", "_inner", "_run", "_head"
    key = ["folder", at]
    here, along = Window.partitionBy(*key).orderBy(*ORDER), Window.partitionBy("folder").orderBy(at)
    d = shots.withColumn(n, now).withColumn(at, F.coalesce(F.floor(F.col("time") / stretch), F.lit(-(1 << 62))))
    before = F.lag(n).over(here)
    d = d.withColumn(inner, F.when(before.isNull(), 0).otherwise(begins(F.col(n), before))).withColumn(run, F.sum(inner).over(here))
    ends = d.groupBy(*key).agg(F.min(n).alias("_first"), F.max(n).alias("_last"), F.sum(inner).alias("_sum"))
    ends = ends.withColumn("_edge", F.lag("_last").over(along)).withColumn(head, F.when(F.col("_edge").isNull(), 1).otherwise(begins(F.col("_first"), F.col("_edge"))))
    ends = ends.select(F.col("folder").alias("_f"), F.col(at).alias("_a"), (F.sum(F.col("_sum") + F.col(head)).over(along) - F.col("_sum")).alias("_base"))
    d = d.join(ends, F.col("folder").eqNullSafe(F.col("_f")) & (F.col(at) == F.col("_a")))
    others = [c for c in shots.columns if c != "group_id"]
    return d.select(*others, (F.col("_base") + F.col(run) - 1).cast("int").alias("group_id"))


def group(shots: DataFrame, cfg: CullConfig = CullConfig(), stretch: float = STRETCH) -> DataFrame:
    """Adds group_id, from 0 in each folder's capture order (see numbered and begins)."""
    return numbered(shots, compared(shots, cfg), lambda now, before: begins(now, before, shots, cfg), stretch)


def regroup(grouped: DataFrame, splits: DataFrame, joins: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """Replaces group_id by that of a user's edits, tables of (folder, file): a frame starts a group if it is the first,
    or is not joined and started one before or is split off. A join beats a split."""
    mark = lambda d, name: d.select("folder", "file").distinct().withColumn(name, F.lit(True))
    d = grouped.join(mark(splits, "_split"), ["folder", "file"], "left").join(mark(joins, "_join"), ["folder", "file"], "left")
    now = F.struct("time", "file", "group_id", F.col("_split").isNotNull().alias("split"), F.col("_join").isNotNull().alias("join"))
    new = lambda this, before: (~this["join"] & ((this["group_id"] != before["group_id"]) | this["split"])).cast("int")
    return numbered(d, now, new, stretch).select(*[c for c in grouped.columns if c != "group_id"], "group_id")
