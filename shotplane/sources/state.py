"""Saved user state: sessions, and the library of named people. Text that cannot be read counts as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane import schema
from shotplane.operators.graph import cut


def parse_sessions(texts: DataFrame) -> DataFrame:
    """Session rows (folder, text) with their six collections; missing keys are empty, unknown ones ignored."""
    s = F.from_json("text", schema.SESSION)
    d = texts.select("folder", s.alias("s"))
    return d.select("folder", *(F.coalesce(F.col(f"s.{f.name}"), F.create_map().cast(f.dataType) if f.dataType.typeName() == "map" else F.array().cast(f.dataType)).alias(f.name) for f in schema.SESSION))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session files, one JSON text a folder."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parse_sessions(d.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "text"))


def decisions(sessions: DataFrame) -> DataFrame:
    return sessions.select("folder", F.explode("decisions").alias("file", "d")).select("folder", "file", "d.mark", "d.stars")


def edits(sessions: DataFrame, kind: str) -> DataFrame:
    """A user's splits or joins: folder, file."""
    return sessions.select("folder", F.explode(kind).alias("file"))


def overrides(sessions: DataFrame) -> DataFrame:
    return sessions.select("folder", F.explode("people").alias("key", "person_id"))


def sent(sessions: DataFrame) -> DataFrame:
    d = sessions.select("folder", F.explode("sent").alias("file", "s"))
    return d.select("folder", "file", F.col("s.rating.set").alias("rating_set"), F.col("s.rating.before").alias("rating_before"), F.col("s.green").alias("green_before"), F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"))


def with_sent(sessions: DataFrame, sent: DataFrame) -> DataFrame:
    """Sessions whose record of what is sent is replaced by rows (folder, file, rating_set, rating_before, green_before,
    tags)."""
    one = F.struct(F.when(F.col("rating_set").isNotNull(), F.struct(F.col("rating_set").alias("set"), F.col("rating_before").alias("before"))).alias("rating"), F.col("green_before").alias("green"), "tags")
    rows = sent.groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("file", one.alias("s")))).cast(schema.SESSION["sent"].dataType).alias("_sent"))
    d = sessions.drop("sent").join(rows, "folder", "left")
    return d.withColumn("sent", F.coalesce("_sent", F.create_map().cast(schema.SESSION["sent"].dataType))).select(*sessions.columns)


def upsert(sessions: DataFrame, edits: DataFrame, collection: str) -> DataFrame:
    """Sessions with entries of a map collection (`people`, `crops`, `decisions`) set to those of edits (folder, key, value);
    a null value takes the entry away. A folder without a session gets one. The last of equal keys counts, by value."""
    kind = schema.SESSION[collection].dataType
    rows = edits.groupBy("folder", "key").agg(F.max("value").alias("value")).groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    d = sessions.join(rows, "folder", "full_outer")
    new = F.coalesce("_new", F.create_map().cast(rows.schema["_new"].dataType))
    old = F.map_filter(F.coalesce(collection, F.create_map().cast(kind)), lambda k, _: ~F.map_contains_key(new, k))
    merged = F.map_concat(old, F.map_filter(new, lambda _, v: v.isNotNull()).cast(kind))
    others = [F.coalesce(f.name, F.create_map().cast(f.dataType) if f.dataType.typeName() == "map" else F.array().cast(f.dataType)).alias(f.name) for f in schema.SESSION if f.name != collection]
    return d.select("folder", *others, merged.alias(collection)).select(*sessions.columns)


def assign_faces(sessions: DataFrame, faces: DataFrame) -> DataFrame:
    """A user's assignments (folder, file, face_idx, person_id; 0 is nobody, null takes the assignment back)."""
    return upsert(sessions, faces.select("folder", F.concat_ws(":", "file", "face_idx").alias("key"), F.col("person_id").alias("value")), "people")


def set_crops(sessions: DataFrame, crops: DataFrame) -> DataFrame:
    """The kept crops of frames (folder, file, crops: array of crop and ratio), replaced whole; null or none clears them."""
    value = F.when(F.size("crops") > 0, F.col("crops"))
    return upsert(sessions, crops.select("folder", F.col("file").alias("key"), value.alias("value")), "crops")


def kept_crops(sessions: DataFrame) -> DataFrame:
    """Crops kept by a user: folder, file, x, y, w, h, rn, rd."""
    d = sessions.select("folder", F.explode("crops").alias("file", "cs")).select("folder", "file", F.explode("cs").alias("c"))
    return d.select("folder", "file", "c.crop.*", F.col("c.ratio.n").alias("rn"), F.col("c.ratio.d").alias("rd"))


def save_sessions(sessions: DataFrame, path: str) -> None:
    """Saves sessions by folder; they are held in a shared table first, as they may come from the very files."""
    sessions, _ = cut(sessions, "sessions")
    sessions.select("folder", F.to_json(F.struct(*(f.name for f in schema.SESSION))).alias("value")).write.mode("overwrite").partitionBy("folder").text(path)


def parse_library(texts: DataFrame) -> DataFrame:
    """People of a library text in their order: id, name, samples, pos."""
    d = texts.select(F.from_json("text", schema.LIBRARY).alias("l")).select(F.posexplode("l.people").alias("pos", "p"))
    return d.select("p.id", "p.name", F.coalesce("p.samples", F.array().cast("array<array<double>>")).alias("samples"), "pos")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return parse_library(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def save_library(library: DataFrame, path: str) -> None:
    """One row a person; the reader takes them in order of id."""
    library.select("id", "name", "samples").write.mode("overwrite").json(path)
