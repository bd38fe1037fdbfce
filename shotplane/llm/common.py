"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.operators.graph import blocks, components, cut, discard, scope, scratch

__all__ = ["blocks", "components", "cut", "discard", "id_field", "key_filter", "map_batches", "map_groups", "passing", "scope", "scratch", "spread", "table", "tidy", "unused", "whole_ids"]

#: Rows that a Python function gets at once. The bytes of a batch that reaches a worker are bounded by Spark itself
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
BATCH_ROWS = 1024
#: Bytes of input a core below which rows are dealt to all cores before Python reads them.
SMALL = 4 << 20

#: Words of 64 bits of a key filter: however many keys there are, no more than this is broadcast (some 20 MB).
FILTER_WORDS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that a frame does not have, after the wanted ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def id_field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def _bit(h: Column) -> Column:
    return F.pmod(h, F.lit(FILTER_WORDS * 64))


def key_filter(hashes: DataFrame, repeated: bool = False) -> DataFrame:
    """A bitmap filter, as a table of words (word, bits), of the 64-bit hashes in column `h`; with `repeated`, of those
    whose bit is met more than once. It never misses a key; the fuller it is, the more others pass, too."""
    bits = hashes.select(_bit(F.col("h")).alias("p"))
    if repeated:
        bits = bits.groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    return bits.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))


def passing(df: DataFrame, h: Column, words: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose hash a filter may hold; with inside=False those which it does not hold. Nothing is shuffled: the
    words are broadcast, and there are at most FILTER_WORDS of them. Write the words first, so that both halves agree."""
    w, b = unused(df, "_word", "_bits")
    held = F.broadcast(words.select(F.col("word").alias(w), F.col("bits").alias(b)))
    hit = (F.shiftright(_bit(h), 6) == F.col(w)) & (F.getbit(F.col(b), _bit(h).bitwiseAND(63).cast("int")) == 1)
    return df.join(held, hit, "left_semi" if inside else "left_anti")


def whole_ids(df: DataFrame, name: str) -> None:
    """Refuses ids that are no whole numbers where a component is named by its smallest id."""
    if df.schema[name].dataType not in (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()):
        raise TypeError(f"{name} must be a whole number, not {df.schema[name].dataType.simpleString()}")


def tidy() -> None:
    """Gives memory that a task has freed back to the system: workers live on, and their executor's bound is shared."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spread(df: DataFrame) -> DataFrame:
    """A small input in few files over all cores: a file with one row group would be read by one task. Beyond SMALL a core,
    the scan has tasks enough and rows stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow over batches of few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(b.slice(lo, BATCH_ROWS) for b in batches for lo in range(0, b.num_rows, BATCH_ROWS))
        tidy()

    return spread(df).mapInArrow(run, schema)


def map_groups(df: DataFrame, key: str, fn: Callable[[dict[str, np.ndarray | list]], dict[str, np.ndarray | list] | None], schema: T.StructType) -> DataFrame:
    """Runs fn on the rows of each value of a bigint column, one group in memory at a time.

    fn gets and returns columns: numpy arrays of numbers, lists of anything else. Groups must have a bounded size;
    callers split larger ones over several values first.
    """
    names = df.columns
    out_schema = schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow_schema(out_schema)
        held: list[pa.RecordBatch] = []
        ready: list[dict] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            cols = [pa.concat_arrays([pa.array(r[f.name], f.type) for r in ready]) for f in kinds]
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, schema=kinds)

        def one(parts: list[pa.RecordBatch]) -> int:
            t = pa.Table.from_batches(parts)
            got = fn({n: _column(t.column(n)) for n in names})
            if got is None:
                return 0
            n = len(next(iter(got.values())))
            if n:
                ready.append(got)
            return n

        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(names.index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column(names.index(key))[0].as_py() != k[lo]:
                    rows += one(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
            if rows > 20_000:
                yield flush()
                rows = 0
        if held:
            rows += one(held)
        if ready:
            yield flush()
        tidy()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _column(c: pa.ChunkedArray) -> np.ndarray | list:
    return c.to_numpy() if pa.types.is_integer(c.type) or pa.types.is_floating(c.type) else c.to_pylist()


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema])
