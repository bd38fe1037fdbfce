"""Filters, counts and neighbours that a reader of judged frames asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotplane.operators.group import ORDER, in_order

KEY = ("folder", "group_id")


def shown(which: str, decided: Column) -> Column:
    """Whether a frame is shown by a filter: all, pending (undecided), picked or rejected, as the user decided."""
    return {"all": F.lit(True), "pending": decided.isNull(), "picked": decided == "pick", "rejected": decided == "reject"}[which]


def tiles(frames: DataFrame, which: str = "all", hide_rejected: bool = False, person: int | None = None) -> DataFrame:
    """Frames that are shown. Rejected ones can be hidden, but for the filter that asks for them; a person's frames hold
    one of their faces (an array of ids, `persons`)."""
    d = frames.where(shown(which, F.col("decided")))
    if hide_rejected and which != "rejected":
        d = d.where(F.coalesce(F.col("decided") != "reject", F.lit(True)))
    return d.where(F.array_contains("persons", person)) if person is not None else d


def judgeable(reasons: Column, has_eyes: Column) -> Column:
    """Whether eyes can be shown for judging: there is a crop of them, and no reason says that no face is usable."""
    return has_eyes & ~F.arrays_overlap(reasons, F.array(*map(F.lit, ("no-face", "face-hidden", "small-face"))))


def counts(frames: DataFrame, *keys: str) -> DataFrame:
    """Totals of picks (by effective mark), rejects (decided ones only) and undecided frames, by keys or over all."""
    return frames.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("effective") == "pick").alias("picks"), F.count_if(F.col("decided") == "reject").alias("rejects"), F.count_if(F.col("decided").isNull()).alias("pending"))


def covers(frames: DataFrame) -> DataFrame:
    """Each group's cover: its first effective pick, or else its first frame."""
    first = F.min(F.struct((F.col("effective") != "pick").alias("rest"), "time", "file"))
    return frames.groupBy(*KEY).agg(first.alias("s")).select(*KEY, F.col("s.file").alias("cover"))


def positions(frames: DataFrame) -> DataFrame:
    """Adds a frame's place in its group, from 1, and the group's size."""
    return frames.withColumns({"position": F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)), "size": F.count("*").over(Window.partitionBy(*KEY))})


def partners(frames: DataFrame) -> DataFrame:
    """For each frame of a group of several the one to compare it with: the best-scored other pick, or else the best
    other frame.

    Only a group's first two in that order can be partners, so they are gathered by group and joined, not all pairs.
    """
    order = Window.partitionBy(*KEY).orderBy(F.col("effective") != "pick", F.desc("score"), *ORDER)
    ranked = frames.select(*KEY, "file", F.row_number().over(order).alias("r"))
    two = ranked.where("r <= 2").groupBy(*KEY).agg(F.max(F.when(F.col("r") == 1, F.col("file"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("file"))).alias("b"))
    return frames.join(two, list(KEY)).select(*KEY, "file", F.when(F.col("file") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("partner")).where("partner is not null")


def neighbours(frames: DataFrame) -> DataFrame:
    """Each frame's neighbours in its folder, and the first frames of the groups before and after its own."""
    w = in_order()
    lead = F.min(F.struct("time", "file")).over(Window.partitionBy(*KEY))
    d = frames.withColumn("_lead", lead)
    heads = frames.groupBy(*KEY).agg(F.min(F.struct("time", "file")).alias("h"))
    g = Window.partitionBy("folder").orderBy("group_id")
    heads = heads.select(*KEY, F.lag("h.file").over(g).alias("group_before"), F.lead("h.file").over(g).alias("group_after"))
    return d.select(*KEY, "file", F.lag("file").over(w).alias("before"), F.lead("file").over(w).alias("after")).join(heads, list(KEY))


def serve(frames: DataFrame, faces: DataFrame, crops: DataFrame) -> DataFrame:
    """Serving rows: one JSON text a folder's frame, with its faces and kept crops.

    faces: folder, file, face_idx, person, eyes; crops: folder, file, ratio. Both are gathered by frame before they are
    joined.
    """
    by = ["folder", "file"]
    f = faces.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("face_idx", "person", "eyes"))).alias("faces"))
    c = crops.groupBy(*by).agg(F.array_sort(F.collect_list("ratio")).alias("crops"))
    body = F.struct(F.col("file"), F.col("group_id").alias("group"), F.col("mark"), F.col("decided").alias("decision"), F.col("reasons"), F.round("score", 6).alias("score"), F.col("faces"), F.col("crops"))
    return frames.drop("faces", "crops").join(f, by, "left").join(c, by, "left").select(*by, F.to_json(body).alias("view"))


def decide(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """A user's changes to decisions, both (folder, file, mark, stars): the latest change of a file (by `at`) wins, and
    one with a null mark removes its decision."""
    last = changes.groupBy("folder", "file").agg(F.max(F.struct("at", "mark", "stars")).alias("c"))
    d = decisions.select("folder", "file", F.col("mark").alias("_m"), F.col("stars").alias("_s")).join(last, ["folder", "file"], "full_outer")
    return d.select("folder", "file", F.when(F.col("c").isNull(), F.col("_m")).otherwise(F.col("c.mark")).alias("mark"), F.when(F.col("c").isNull(), F.col("_s")).otherwise(F.col("c.stars")).alias("stars")).where("mark is not null")


def accept(frames: DataFrame) -> DataFrame:
    """Accepts groups as they were pre-marked: undecided frames take their mark as their decision."""
    return frames.withColumn("decided", F.coalesce("decided", "mark"))


def toggled(decided: Column, mark: str) -> Column:
    """A frame's decision after its key for a mark: the mark, or none where it had it."""
    return F.when(decided.eqNullSafe(F.lit(mark)), "none").otherwise(mark)


def mark_groups(frames: DataFrame, mark: str) -> DataFrame:
    """Decisions after whole groups are marked: none where all of a group's frames had the mark already."""
    every = F.min((F.coalesce("decided", F.lit("")) == mark).cast("int")).over(Window.partitionBy(*KEY))
    return frames.withColumn("decided", F.when(every == 1, "none").otherwise(mark))


def visible_groups(shown_tiles: DataFrame) -> DataFrame:
    """Groups with a frame that is shown, and their place in the folder."""
    g = shown_tiles.select(*KEY).distinct()
    return g.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("group_id")))
