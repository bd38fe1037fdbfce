"""Photo files of a folder, their metadata, and incremental scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane import schema
from shotplane.functions.exif import parse_exif_time, sub_second
from shotplane.functions.text import JPEG_EXTENSIONS, RAW_EXTENSIONS, extension, file_name, stem

#: Version of saved analyses; others are computed again.
VERSION = 1


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder's own files: folder, file, size, mtime (seconds). No content is read."""
    d = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return d.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), file_name(F.col("path")).alias("file"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def photos(files: DataFrame) -> DataFrame:
    """Photos among files (folder, file): raw and JPEG ones, a JPEG only if no raw file of its folder has its stem."""
    ext = extension(F.col("file"))
    raw = files.where(ext.isin(*RAW_EXTENSIONS))
    stems = raw.select("folder", stem(F.col("file")).alias("_stem")).distinct()
    jpeg = files.where(ext.isin(*JPEG_EXTENSIONS)).withColumn("_stem", stem(F.col("file"))).join(stems, ["folder", "_stem"], "left_anti").drop("_stem")
    return raw.unionByName(jpeg)


def read_exif(spark: SparkSession, path: str) -> DataFrame:
    """Exported metadata rows (JSON lines): folder, file, time, orientation."""
    return exif_rows(spark.read.schema(schema.EXIF).json(path))


def exif_rows(rows: DataFrame) -> DataFrame:
    """Capture time in seconds, 0 if it cannot be read; orientation, 1 if it is missing. Folder and file are those of
    SourceFile; a bare name has an empty folder."""
    t = F.coalesce(parse_exif_time(F.col("DateTimeOriginal")), F.lit(0.0)) + sub_second(F.col("SubSecTimeOriginal"))
    folder = F.when(F.contains("SourceFile", F.lit("/")), F.regexp_replace("SourceFile", "/[^/]*$", "")).otherwise("")
    return rows.select(folder.alias("folder"), file_name(F.col("SourceFile")).alias("file"), t.alias("time"), F.coalesce("Orientation", F.lit(1)).alias("orientation"))


def scan(files: DataFrame, exif: DataFrame) -> DataFrame:
    """Photos in capture order with time and orientation: files of one name in several folders have their own."""
    d = photos(files).join(exif.dropDuplicates(["folder", "file"]), ["folder", "file"], "left")
    return d.select(*files.columns, F.coalesce("time", F.lit(0.0)).alias("time"), F.coalesce("orientation", F.lit(1)).alias("orientation")).orderBy("folder", "time", "file")


FINGERPRINT = ["folder", "file", "size", "mtime"]


def cache_hits(cached: DataFrame, listing: DataFrame, version: int = VERSION) -> DataFrame:
    """Saved analyses that still hold: same version, no error, and file, size and time as listed."""
    return cached.where((F.col("version") == version) & F.col("error").isNull()).join(listing.select(*FINGERPRINT), FINGERPRINT, "left_semi")


def cache_misses(cached: DataFrame, listing: DataFrame, version: int = VERSION) -> DataFrame:
    """Listed files without a valid analysis."""
    return listing.join(cache_hits(cached, listing, version).select(*FINGERPRINT), FINGERPRINT, "left_anti")


def merge(hits: DataFrame, fresh: DataFrame) -> DataFrame:
    """The folder's analyses: those that hold, and those made anew."""
    return hits.unionByName(fresh)


def stale_identity(hits: DataFrame) -> DataFrame:
    """Analyses that have faces and no identity vectors yet."""
    return hits.where("not embedded and size(faces) > 0")


def save(analyses: DataFrame, path: str) -> None:
    """Saves analyses by folder; the committer makes it whole or not at all."""
    analyses.write.mode("overwrite").partitionBy("folder").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
