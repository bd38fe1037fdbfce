"""Best-fit packing of token pieces, by residual rounds up a tree of partitions."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.llm.common import cut, discard, id_field, map_batches
from shotplane.llm.token_counts import CHUNK, encode_spliced, encoder, fast_encoder, tokenizer_path

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Free tokens up to which a bin is nearly full, pieces a task packs at once (which costs a sequence a batch at most), and
#: groups of bins that a merge joins.
NEARLY, AT_ONCE, FAN_IN = 2, 50_000, 8


def encode_text(path: str, text: str) -> bytes:
    """The ids of a text as bytes; long texts are encoded in spliced chunks by the library, loaded once one comes."""
    ids = fast_encoder(path)(text) if len(text) <= CHUNK else np.asarray(encode_spliced(encoder(path), text))
    return ids.astype("<u4", copy=False).tobytes()


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit by decreasing length: each item's bin and place, and the bins' fill.

    Open bins stand by their free space, so an item finds the fullest bin that holds it by a search in the sorted list of
    spaces in use.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, places, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        k = bisect_left(spaces, n)
        if k == len(spaces):
            b = len(fill)
            fill.append(0)
        else:
            s = spaces[k]
            b = free[s].pop()
            if not free[s]:
                del spaces[k]
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        s = capacity - fill[b]
        if s:
            if not free[s]:
                insort(spaces, s)
            free[s].append(b)
    return bins, places, fill


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(a, capacity) for a in range(first, n, capacity)]


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, nearly: int = NEARLY, fan_in: int = FAN_IN) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is an empty
    one, which is a piece of the end id alone. Repeated and null ids are documents of their own; other columns are left
    out.

    Every partition packs its pieces best-fit and closes nearly full bins. Underfull bins go up a tree as items: a round
    joins those of `fan_in` partitions and packs them again by best fit, until one group is left (see merge_rounds).
    """
    path = path or tokenizer_path()
    schema = T.StructType([id_field(docs, "doc_id"), T.StructField("piece", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "bin", "place", "fill", "part")])
    kinds = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ending = int(end).to_bytes(4, "little")
        part, made = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            n = np.array([r[3] for r in rows], np.int64)
            bins, places, fill = best_fit(n, capacity)
            fills = np.asarray(fill, np.int64)
            names = (np.int64(part) << 32) + made + bins
            made += len(fill)
            owner = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.concat_arrays(ids).take(owner), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array(n), pa.array([r[4] for r in rows], pa.int64()), pa.array(names), pa.array(places), pa.array(fills[bins]), pa.array(np.full(len(n), part, np.int64))]
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(cols, names=kinds)

        seen = 0
        for b in batches:
            ids.append(b.column(0))
            for i, x in enumerate(b.column(1).to_pylist()):
                data = encode_text(path, x) + ending
                for k, (a, n) in enumerate(cut_pieces(len(data) // 4, capacity)):
                    rows.append((seen + i, k, a, n, zlib.crc32(data[4 * a : 4 * (a + n)])))
            seen += b.num_rows
            if len(rows) >= AT_ONCE:
                yield flush()
                seen = 0
        if rows:
            yield flush()

    spark = docs.sparkSession
    pieces, _ = cut(map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, schema), "pieces")
    bins = pieces.where((F.col("fill") < capacity - nearly) & (F.col("place") == 0)).select("bin", "fill", "part")
    moves = merge_rounds(bins, capacity, nearly, fan_in)
    moved = pieces.where(F.col("fill") < capacity - nearly).join(moves, "bin", "left")
    still = pieces.where(F.col("fill") >= capacity - nearly)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return still.select(*out, F.col("bin").alias("sequence_id"), F.col("place").alias("offset")).unionByName(moved.select(*out, F.coalesce("target", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset")))


def merge_rounds(bins: DataFrame, capacity: int, nearly: int, fan_in: int) -> DataFrame:
    """Packs underfull bins (bin, fill, part) round by round; returns for each: bin, target (a bin's name), shift.

    Best fit leaves no two bins that fit into one, so in a batch, and in a merged group, at most one is half full or less.
    In a merge of m such small bins, each goes into at most one larger bin, and larger ones never join each other. Of bins
    equally full any will do; so m of each fill, beside the small ones, give what all of them would. Only these reach the
    task: no more than `fan_in` times the capacity, however many bins there are; the others wait, open, for the next
    round.
    """
    spark = bins.sparkSession
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("bin", "target", "shift", "fill", "part")])
    now, path = cut(bins.select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"), "fill", "part"), "bins")

    def merge(key, frame):
        import pandas as pd

        items = frame.sort_values(["fill", "bin"], kind="stable")
        where, places, fill = best_fit(items["fill"].to_numpy(), capacity)
        head = {}
        for b, name in zip(where.tolist(), items["bin"].tolist()):
            head[b] = min(head.get(b, name), name)
        fills = np.asarray(fill, np.int64)
        return pd.DataFrame({"bin": items["bin"].to_numpy(), "target": [head[b] for b in where.tolist()], "shift": places, "fill": fills[where], "part": int(key[0])})

    while True:
        low = now.where((F.col("fill") < capacity - nearly) & (F.col("shift") == 0)).select(F.col("target").alias("bin"), "fill", F.floor(F.col("part") / fan_in).cast("long").alias("part"))
        n = now.agg(F.max("part")).first()[0]
        small = low.where(F.col("fill") * 2 <= capacity).groupBy("part").agg(F.count("*").alias("m"))
        tried = low.join(small, "part").withColumn("r", F.row_number().over(Window.partitionBy("part", "fill").orderBy("bin"))).where(F.col("r") <= F.greatest(F.col("m"), F.when(F.col("fill") * 2 <= capacity, F.col("r")).otherwise(0)))
        packed, path_packed = cut(tried.select("bin", "fill", "part").groupBy("part").applyInPandas(merge, schema), "bins")
        step = packed.select(F.col("bin").alias("t"), F.col("target").alias("t2"), F.col("shift").alias("s2"), F.col("fill").alias("f2"), F.col("part").alias("p2"))
        then, path_then = cut(now.join(step, now["target"] == step["t"], "left").select("bin", F.coalesce("t2", "target").alias("target"), (F.col("shift") + F.coalesce("s2", F.lit(0))).cast("long").alias("shift"), F.coalesce("f2", "fill").alias("fill"), F.coalesce("p2", F.floor(F.col("part") / fan_in)).cast("long").alias("part")), "bins")
        discard(spark, path)
        discard(spark, path_packed)
        now, path = then, path_then
        if n is None or n < fan_in:
            return now.select("bin", "target", "shift")
