"""Sessions of a stream by time gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, gap: str = "45 seconds", late: str | None = None) -> DataFrame:
    """Sessions by key (folder) whose events follow within the gap: folder, started, n, best.

    The same on a batch and on a stream; there, `late` sets the watermark after which a session is closed.
    """
    d = events.withWatermark("ts", late) if late else events
    return d.groupBy("folder", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("best")).select("folder", F.col("w.start").alias("started"), "n", "best")
