"""An editor's library, and the files through which changes and receipts pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane.functions.text import change_line, parse_change, queue_name
from shotplane.operators.graph import discard

BY = ["folder", "file"]


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of the editor's library over JDBC, read only."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def canonical(path: Column) -> Column:
    """A folder's path without what does not change it: `/./`, doubled slashes, a closing slash."""
    return F.regexp_replace(F.regexp_replace(path, r"/(?:\./)*(?:/(?:\./)*)*", "/"), r"(?<=.)/\.?$", "")


def imported(rolls: DataFrame, images: DataFrame, folders: DataFrame) -> DataFrame:
    """Files that the editor has: rolls (id, roll) of the folders asked for (folder, roll), and their images (film_id,
    filename). Rolls meet folders by their canonical spelling: without doubled or closing slashes and single dots."""
    rolls = rolls.select("id", canonical(F.col("roll")).alias("_roll"))
    return folders.withColumn("_roll", canonical(F.col("roll"))).join(rolls, "_roll").join(images, F.col("id") == F.col("film_id")).select("folder", "roll", F.col("filename").alias("file"))


def locations(home: str, config_home: str | None = None, cache_home: str | None = None, tool: str = "shotplane") -> dict[str, str]:
    """Where an editor keeps its library and settings, and where its queues are: by a user's home and the two folders that
    may stand for `.config` and `.cache`. The names are fixed values."""
    config = f"{config_home or home + '/.config'}/darktable"
    return {"library": f"{config}/library.db", "settings": f"{config}/darktablerc", "queue": f"{cache_home or home + '/.cache'}/{tool}/darktable"}


def read_settings(spark: SparkSession, path: str) -> int:
    """The editor's rating on import by its settings file; 1 without the file."""
    lines = spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
    return default_rating(lines)


def default_rating(config: DataFrame, key: str = "ui_last/import_initial_rating", otherwise: int = 1) -> int:
    """The rating that the editor gives on import, from its configuration's lines (value)."""
    row = config.where(F.col("value").startswith(f"{key}=")).select(F.trim(F.substring_index("value", "=", -1)).try_cast("int").alias("r")).first()
    return row["r"] if row and row["r"] is not None else otherwise


def queue_lines(changes: DataFrame, title: str = "queue") -> DataFrame:
    """A queue's lines by roll: a header, then the changes by file: roll, name, place, line."""
    body = changes.select("roll", F.col("file").alias("place"), change_line(F.col("file"), F.col("rating"), F.col("green"), F.col("add"), F.col("remove")).alias("line"))
    head = changes.select("roll").distinct().select("roll", F.lit("").alias("place"), F.concat(F.lit(f"# {title} 1 "), F.col("roll")).alias("line"))
    return head.unionByName(body).withColumn("name", queue_name(F.col("roll"), "todo"))


def write_queue(changes: DataFrame, path: str, rolls: DataFrame | None = None, title: str = "queue") -> None:
    """Replaces the queues of the rolls that have changes. Of the other rolls that are sent (roll), the queues go, so that
    nothing that was withdrawn is applied."""
    spark = changes.sparkSession
    d = queue_lines(changes, title).repartition("name").sortWithinPartitions("name", "place")
    d.select("name", F.col("line").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(path)
    if rolls is not None:
        empty = rolls.select("roll").distinct().join(changes.select("roll").distinct(), "roll", "left_anti")
        for r in empty.select(F.concat(F.lit(f"{path}/name="), _folder_name(queue_name(F.col("roll"), "todo"))).alias("at")).toLocalIterator():
            discard(spark, r["at"])


def _folder_name(name: Column) -> Column:
    """A value as the writer spells it in a folder's name: percent signs are escaped."""
    return F.replace(name, F.lit("%"), F.lit("%25"))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queued changes: folder (the roll of the header), file, rating, green, add, remove, valid."""
    files = spark.read.text(path, wholetext=True).select("value")
    roll = F.regexp_extract("value", r"^# \S+ \d+ ([^\r\n]*)", 1)
    lines = files.select(roll.alias("folder"), F.explode(F.split("value", r"\r?\n")).alias("line")).where("line <> '' and line not like '#%'")
    return lines.select("folder", *(c.alias(k) for k, c in parse_change(F.col("line")).items()))


def apply_queues(spark: SparkSession, path: str, receipts: str, apply: Callable[[DataFrame], DataFrame]) -> int:
    """The editor's side, once a queue: the queues are set aside under another name before they are applied, and go when
    their receipts are written. What an earlier run left aside is applied first; as changes are idempotent, applying
    some again does no harm. apply(changes) returns them with status and values before. Returns how many sets were applied."""
    aside, done = path.rstrip("/") + ".applying", 0
    for leftover in (True, False):
        if not leftover and not _move(spark, path, aside):
            continue
        if exists(spark, aside):
            applied = apply(read_queue(spark, aside).where("valid"))
            receipt_lines(applied).select("folder", F.col("line").alias("value")).write.mode("append").partitionBy("folder").text(receipts)
            discard(spark, aside)
            done += 1
    return done


def consume_receipts(spark: SparkSession, path: str, use: Callable[[DataFrame], None]) -> bool:
    """Receipts in batch, once each: they are set aside, given to use(folder, seq, line), which saves what follows from
    them, and then go. A set that an earlier run left aside comes first. Returns whether there were any."""
    aside, some = path.rstrip("/") + ".taken", False
    for leftover in (True, False):
        if not leftover and not _move(spark, path, aside):
            continue
        if exists(spark, aside):
            files = spark.read.schema("value string, folder string").text(aside, wholetext=True).select("folder", "value", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")).alias("of"))
            parts = files.select("folder", "of", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
            use(parts.select("folder", F.struct("of", "pos").alias("seq"), "line").where("line <> ''"))
            discard(spark, aside)
            some = True
    return some


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def _move(spark: SparkSession, path: str, to: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at) and fs.rename(at, _path(spark, to)[0])


def write_sidecars(texts: DataFrame, path: str) -> None:
    """Writes sidecars (folder, file, text), each replacing the one of its file; others stay. Files end with a line's end."""
    body = F.when(F.endswith("text", F.lit("\n")), F.expr("substring(text, 1, char_length(text) - 1)")).otherwise(F.col("text"))
    d = texts.select("folder", "file", body.alias("value")).repartition("folder", "file")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "file").text(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars as write_sidecars leaves them: folder, file, text."""
    return spark.read.schema("value string, folder string, file string").text(path, wholetext=True).select("folder", "file", F.col("value").alias("text"))


def pending(lines: DataFrame) -> DataFrame:
    """Waiting changes by roll: lines (roll, line) that are neither empty nor comments."""
    return lines.groupBy("roll").agg(F.count_if((F.col("line") != "") & ~F.col("line").startswith("#")).alias("waiting"))


def receipt_lines(applied: DataFrame) -> DataFrame:
    """Receipts of applied changes as lines."""
    line = change_line(F.col("file"), F.col("rating"), F.col("green"), F.col("add"), F.col("remove"))
    return applied.select(*BY, F.concat_ws("\t", "status", F.col("before_rating").cast("string"), F.col("before_green").cast("int").cast("string"), line).alias("line"))


def parse_receipts(lines: DataFrame) -> DataFrame:
    """Receipt lines (folder, seq, line) as applied changes, with their status and whether they are well formed."""
    head = F.split("line", "\t", 4)
    p = parse_change(F.get(head, F.lit(3)))
    rating = F.get(head, F.lit(1)).try_cast("int")
    return lines.where("line <> ''").select("folder", "seq", head[0].alias("status"), rating.alias("before_rating"), (F.get(head, F.lit(2)) == "1").alias("before_green"), *(c.alias(k) for k, c in p.items() if k != "valid"), (F.coalesce(p["valid"], F.lit(False)) & rating.isNotNull()).alias("valid"))
