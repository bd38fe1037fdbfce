"""Command line: runs a query of the catalogue, or a flow over saved tables.

    python -m shotplane query judge_marks /root/testdata/sf0.01
    python -m shotplane judge SHOTS SESSIONS OUT
    python -m shotplane people SHOTS SESSIONS LIBRARY      (prints people by folder)
    python -m shotplane reframe SCENES                     (prints suggested crops)
    python -m shotplane calibrate SHOTS SESSIONS
    python -m shotplane export SHOTS SESSIONS IMPORTED SIDECARS QUEUE [--dry-run]
        IMPORTED: the editor's files (folder, file) as Parquet; SIDECARS: folder=/file= of sidecars, read and written;
        QUEUE: folder of queues. A dry run prints every change with its route and writes nothing.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane import catalogue
from shotplane.operators import graph
from shotplane.plans import flows
from shotplane.sources import editor, listing, state

NEEDS = {"query": 2, "judge": 3, "people": 3, "reframe": 1, "calibrate": 2, "export": 5}


def lines(d: DataFrame, *columns: str) -> None:
    """Prints all rows, a line each, a partition at a time."""
    for r in d.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)).alias("line")).toLocalIterator():
        print(r["line"])


def export(spark: SparkSession, shots: str, sessions: str, imported: str, sidecars: str, queue: str, dry: bool) -> None:
    told = state.read_sessions(spark, sessions)
    frames, files = flows.judged(listing.load(spark, shots), told), spark.read.parquet(imported)
    if dry:
        lines(flows.changes(frames, told, files).orderBy("folder", "file"), "folder", "file", "route", "rating", "green", "add", "remove")
        return
    with graph.scope(spark):
        texts = editor.read_sidecars(spark, sidecars) if editor.exists(spark, sidecars) else spark.createDataFrame([], "folder string, file string, text string")
        report, sent = flows.send(spark, frames, state.sent(told), files, texts, queue, sidecars)
        lines(report.orderBy("folder"), "folder", "written", "queued", "failed", "missing")
        state.save_sessions(state.with_sent(told, sent), sessions)


def main(args: list[str]) -> int:
    dry = "--dry-run" in args
    args = [a for a in args if a != "--dry-run"]
    if not args or len(args) - 1 < NEEDS.get(args[0], 99):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("shotplane").getOrCreate()
    if args[0] == "query":
        catalogue.QUERIES[args[1]](spark, args[2]).show(50, False)
    elif args[0] == "reframe":
        lines(flows.suggested(listing.load(spark, args[1])).orderBy("scene", "place"), "scene", "place", "rn", "rd", "x", "y", "w", "h", "score", "notes")
    elif args[0] == "export":
        export(spark, *args[1:6], dry)
    else:
        shots, sessions = listing.load(spark, args[1]), state.read_sessions(spark, args[2])
        if args[0] == "judge":
            flows.judged(shots, sessions).write.mode("overwrite").partitionBy("folder").parquet(args[3])
        elif args[0] == "people":
            lines(flows.named_people(shots, sessions, state.read_library(spark, args[3])).orderBy("folder", "place"), "folder", "shown", "n_faces", "faces")
        else:
            best, before, after = flows.tuned(shots, sessions)
            print(f"reject errors: {before} now, {after} after", best)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
