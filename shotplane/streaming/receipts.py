"""Receipts as a stream: each batch of new receipt files is folded into what is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotplane.operators.export import record
from shotplane.sources.editor import parse_receipts

EMPTY = "folder string, file string, rating_set int, rating_before int, green_before boolean, tags array<string>"


def follow_receipts(spark: SparkSession, receipts: str, state: str, checkpoint: str) -> StreamingQuery:
    """Folds receipt files (<receipts>/folder=*/*.done) that arrive into versions of a state table, once each.

    Each batch writes version N + 1 under `state` from version N; a batch that runs again writes the same version. Lines
    count in their order in a file, files in the order of their times.
    """
    stream = spark.readStream.format("text").schema("value string, folder string").option("wholetext", "true").load(receipts)
    lines = stream.select("folder", "value", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")).alias("of"))

    def fold(batch: DataFrame, number: int) -> None:
        now = spark.read.parquet(f"{state}/v={number}") if number else spark.createDataFrame([], EMPTY)
        parts = batch.select("folder", "of", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
        ok = parse_receipts(parts.select("folder", F.struct("of", "pos").alias("seq"), "line")).where("valid and status = 'ok'")
        record(now, ok).write.mode("overwrite").parquet(f"{state}/v={number + 1}")

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
