"""Whole flows over saved tables: refresh analyses, judge, name people, calibrate, suggest crops, send changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane.config import CullConfig, PeopleConfig, ReframeConfig
from shotplane.functions import xmp
from shotplane.operators import calibrate, crops, export, group, judge, people
from shotplane.operators.graph import cut
from shotplane.sources import editor, listing, state


def refresh(spark: SparkSession, folder: str, cache: str | None, analyse) -> DataFrame:
    """Analyses of a folder's photos: saved ones that hold, and the others made anew by analyse(files)."""
    files = listing.photos(listing.list_folder(spark, folder))
    if cache is None:
        return analyse(files)
    saved = listing.load(spark, cache)
    return listing.merge(listing.cache_hits(saved, files), analyse(listing.cache_misses(saved, files)))


def judged(shots: DataFrame, sessions: DataFrame, cfg: CullConfig = CullConfig()) -> DataFrame:
    """Frames grouped, regrouped by a user's edits, judged, and joined with their decisions."""
    grouped = group.regroup(group.group(shots, cfg), state.edits(sessions, "splits"), state.edits(sessions, "joins"))
    own = state.decisions(sessions).select("folder", "file", F.col("mark").alias("decided"))
    d = judge.judge(grouped, cfg).join(own, ["folder", "file"], "left")
    return d.withColumn("effective", judge.effective(F.col("decided"), F.col("mark")))


def named_people(shots: DataFrame, sessions: DataFrame, library: DataFrame, cfg: PeopleConfig = PeopleConfig()) -> DataFrame:
    """People of each folder, from frames in capture order."""
    faces = shots.select("folder", "file", F.col("time").alias("ord"), F.posexplode("faces").alias("face_idx", "f")).select("folder", "file", "face_idx", "ord", "f.embed", "f.embed_norm", "f.presence")
    return people.numbered(people.people(faces, library, state.overrides(sessions), cfg))


def tuned(shots: DataFrame, sessions: DataFrame, cfg: CullConfig = CullConfig()) -> tuple[CullConfig, int, int]:
    """Thresholds that agree better with a user's decisions: (config, errors before, errors after)."""
    return calibrate.calibrate(group.group(shots, cfg), state.decisions(sessions).select("folder", "file", "mark"), cfg)


def changes(frames: DataFrame, sessions: DataFrame, imported: DataFrame) -> DataFrame:
    """The changes to send, each with its route: what a dry run shows."""
    return export.route(export.plan(export.targets(frames), state.sent(sessions)), imported)


def collect(sessions: DataFrame, receipts: DataFrame) -> DataFrame:
    """What is sent after receipts (folder, seq, line) are consumed."""
    return export.record(state.sent(sessions), editor.parse_receipts(receipts).where("valid and status = 'ok'"))


def send(spark: SparkSession, frames: DataFrame, sent: DataFrame, imported: DataFrame, sidecars: DataFrame, queue: str, written: str, default_rating: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sends all changes that are due: sidecars (folder, file, text) of files that the editor does not have are edited and
    written under `written`, queues of the others under `queue`; queues of folders without changes go. frames are
    judged ones, sent is what receipts have confirmed. Returns the report by folder, and what is sent now; queued changes
    count once their receipts come.
    """
    by = ["folder", "file"]
    due = export.route(export.plan(export.targets(frames), sent), imported)
    side = due.where("route = 'sidecar'").join(sidecars.select(*by, "text"), by, "left")
    side, _ = cut(side.withColumn("e", xmp.edit_sidecars(default_rating)("file", "text", "rating", "green", "add", "remove")), "sidecars")
    fine = side.where("e.error is null")
    editor.write_sidecars(fine.select(*by, "e.text"), written)
    queued = due.where("route = 'queue'").withColumn("roll", F.col("folder"))
    editor.write_queue(queued, queue, frames.select(F.col("folder").alias("roll")))
    outcome = side.select("folder", F.when(F.col("e.error").isNull(), "written").otherwise("failed").alias("outcome")).unionByName(queued.select("folder", F.lit("queued").alias("outcome")))
    done = fine.select(*by, F.lit(1).alias("seq"), "rating", "green", "add", "remove", "e.before_rating", "e.before_green")
    return export.report(outcome), export.record(sent, done)


def backfill(analyses: DataFrame, exif: DataFrame, embedded: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Analyses once those that have faces and no identity vectors got some: they are joined with fresh metadata for their
    orientation and given to embedded(rows), which returns analyses; the others stay as they are."""
    key = ["folder", "file"]
    stale = listing.stale_identity(analyses)
    fresh = embedded(stale.join(exif.select(*key, F.col("orientation").alias("turned")).dropDuplicates(key), key, "left"))
    return analyses.join(stale.select(*key), key, "left_anti").unionByName(fresh.select(*analyses.columns))


def scenes(saved: DataFrame | None, files: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scenes of files read through a cache: saved ones whose file has not changed, and the others built anew."""
    if saved is None:
        return build(files)
    held = saved.join(files.select(*listing.FINGERPRINT), listing.FINGERPRINT, "left_semi")
    return held.unionByName(build(files.join(held.select(*listing.FINGERPRINT), listing.FINGERPRINT, "left_anti")))


def suggested(scenes: DataFrame, cfg: ReframeConfig = ReframeConfig()) -> DataFrame:
    return crops.suggest(scenes, cfg)
