"""Desired against applied state of files in an editor, as a feed of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ["folder", "file"]
#: A reject's rating, and what marks a reason's tag.
REJECTED, TAG_PREFIX = -1, "cull|reason|"


def no_tags() -> Column:
    return F.array().cast("array<string>")


def targets(judged: DataFrame, prefix: str = TAG_PREFIX) -> DataFrame:
    """What decided files should look like: rating, green, tags. A reject is rated so, a pick is green; both get the
    reasons of the current verdict as tags, whatever it was. Decisions of `none` ask for nothing."""
    tags = F.array_sort(F.transform("reasons", lambda r: F.concat(F.lit(prefix), r)))
    d = judged.where("decided in ('pick', 'reject')")
    return d.select(*BY, F.when(F.col("decided") == "reject", REJECTED).alias("rating"), (F.col("decided") == "pick").alias("green"), tags.alias("tags"))


def plan(target: DataFrame, sent: DataFrame) -> DataFrame:
    """The changes that take files from what was sent (rating_set, rating_before, green_before, tags) to their targets:
    rating (`keep`, `set:N`, `restore:E:T`), green (`keep`, `set`, `restore:0|1`), add, remove. Files without any change
    are left out."""
    t = target.select(*BY, F.col("rating").alias("want"), F.col("green").alias("want_green"), F.col("tags").alias("want_tags"))
    s = sent.select(*BY, "rating_set", "rating_before", "green_before", F.col("tags").alias("had_tags"))
    d = t.join(s, BY, "full_outer")
    want, had, green = F.col("want"), F.col("rating_set"), F.coalesce("want_green", F.lit(False))
    rating = F.when(want.isNotNull() & want.eqNullSafe(had), "keep").when(want.isNotNull(), F.concat(F.lit("set:"), want.cast("string"))).when(had.isNotNull(), F.concat_ws(":", F.lit("restore"), had.cast("string"), F.col("rating_before").cast("string"))).otherwise("keep")
    light = F.when(green & F.col("green_before").isNull(), "set").when(~green & F.col("green_before").isNotNull(), F.concat(F.lit("restore:"), F.col("green_before").cast("int").cast("string"))).otherwise("keep")
    new, old = F.coalesce("want_tags", no_tags()), F.coalesce("had_tags", no_tags())
    out = d.select(*BY, rating.alias("rating"), light.alias("green"), F.array_sort(F.array_except(new, old)).alias("add"), F.array_sort(F.array_except(old, new)).alias("remove"))
    return out.where("rating <> 'keep' or green <> 'keep' or size(add) > 0 or size(remove) > 0")


def record(sent: DataFrame, applied: DataFrame) -> DataFrame:
    """What is sent after applied changes: their columns, before_rating and before_green (what each replaced), and `seq`,
    their order in a file.

    A repeated set keeps the first value that it replaced. Changes are folded by file in their order; files for which
    nothing is left sent go.
    """
    kind = "struct<set:int,before:int,green:boolean,tags:array<string>>"
    steps = applied.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("seq", "rating", "green", "add", "remove", "before_rating", "before_green"))).alias("steps"))
    d = sent.select(*BY, F.struct(F.col("rating_set").alias("set"), F.col("rating_before").alias("before"), F.col("green_before").alias("green"), "tags").cast(kind).alias("now")).join(steps, BY, "full_outer")
    empty = F.struct(F.lit(None).alias("set"), F.lit(None).alias("before"), F.lit(None).alias("green"), no_tags().alias("tags")).cast(kind)

    def step(s: Column, c: Column) -> Column:
        setting, restoring = c["rating"].startswith("set:"), c["rating"].startswith("restore:")
        value = F.regexp_extract(c["rating"], r"^set:(-?\d+)$", 1).try_cast("int")
        return F.struct(
            F.when(setting, value).when(restoring, F.lit(None)).otherwise(s["set"]).alias("set"),
            F.when(setting, F.when(s["set"].isNotNull(), s["before"]).otherwise(c["before_rating"].cast("int"))).when(restoring, F.lit(None)).otherwise(s["before"]).alias("before"),
            F.when(c["green"] == "set", F.coalesce(s["green"], c["before_green"])).when(c["green"].startswith("restore:"), F.lit(None)).otherwise(s["green"]).alias("green"),
            F.array_except(F.array_union(s["tags"], c["add"]), c["remove"]).alias("tags"),
        ).cast(kind)

    now = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), F.coalesce("now", empty), step)
    out = d.select(*BY, now.alias("now")).select(*BY, F.col("now.set").alias("rating_set"), F.col("now.before").alias("rating_before"), F.col("now.green").alias("green_before"), F.array_sort("now.tags").alias("tags"))
    return out.where("rating_set is not null or green_before is not null or size(tags) > 0")


def levels(tags: Column) -> Column:
    """Every level of every tag."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tags, lambda t: F.split(t, r"\|")))))


def tag_levels(hierarchy: Column, subject: Column, add: Column, remove: Column) -> tuple[Column, Column]:
    """(hierarchy, subject) after adding and removing tags: a level goes only if no tag that is left has it, and the levels
    of added tags come in."""
    left = F.array_sort(F.array_union(F.array_except(hierarchy, remove), add))
    gone = F.array_except(levels(remove), levels(left))
    return left, F.array_sort(F.array_union(F.array_except(subject, gone), levels(add)))


def apply_changes(images: DataFrame, changes: DataFrame) -> DataFrame:
    """The editor's side: queued changes applied to its images (folder, file, rating, green, duplicate), with receipts.

    Only the first version of an image counts. Returns for each change: status (`ok`, `missing`), before_rating,
    before_green and the image's rating and green after it. Applying a change twice leaves the same state.
    """
    first = images.where("duplicate = 0").select(*BY, F.col("rating").alias("r0"), F.col("green").alias("g0"))
    d = changes.join(first, BY, "left")
    found = F.col("r0").isNotNull()
    to_set = F.regexp_extract("rating", r"^set:(-?\d+)$", 1).try_cast("int")
    expect, back = (F.regexp_extract("rating", r"^restore:(-?\d+):(-?\d+)$", k).try_cast("int") for k in (1, 2))
    after = F.when(to_set.isNotNull(), to_set).when(expect == F.col("r0"), back).otherwise(F.col("r0"))
    light = F.when(F.col("green") == "set", True).when(F.col("green") == "restore:0", False).otherwise(F.col("g0"))
    return d.select(*changes.columns, F.when(found, "ok").otherwise("missing").alias("status"), F.when(found, F.col("r0")).otherwise(0).alias("before_rating"), F.when(found, F.col("g0")).otherwise(False).alias("before_green"), F.when(found, after).alias("rating_after"), F.when(found, light).alias("green_after"))


def route(changes: DataFrame, imported: DataFrame) -> DataFrame:
    """Adds where a change goes: to the queue of an editor that has the file, or to a sidecar."""
    known = imported.select(*BY).distinct().withColumn("_in", F.lit(True))
    return changes.join(known, BY, "left").withColumn("route", F.when(F.col("_in").isNotNull(), "queue").otherwise("sidecar")).drop("_in")


def report(outcomes: DataFrame) -> DataFrame:
    """Changes by outcome (written, queued, failed, missing) of each folder."""
    kinds = ("written", "queued", "failed", "missing")
    return outcomes.groupBy("folder").agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: a keyed merge of a log."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
