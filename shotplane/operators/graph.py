"""Shared tables, connected components, and large groups dealt over pairs of blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local run gets a folder of its
    own; a cluster, whose machines would not see that, gets an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="shotplane-")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Links that one task settles.
FEW = 4096

_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Discards, at its end, the tables that were cut within it: write or collect what is built from them before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)


def cut(df: DataFrame, tag: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it again: its lineage ends here, and a lost executor costs nothing.
    With `keep` it outlives the scope that it is made in."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/shotplane/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component), the component being its smallest node.

    Alternating large and small stars. Each round is one pass of joins over the links that are left, cut to a shared
    table, and so are the least neighbours, so that a round's joins have one plain exchange a side and a hub's links can
    be split. Links that fit one block (FEW) are settled by one task without rounds, with the same result.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now, path = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    if 0 < mark[0] <= FEW:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInPandas(_settled, f"node {kind}, component {kind}")
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, path_least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "least")
        large, path_large = cut(both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lows, path_lows = cut(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m"), "lows")
        small = large.join(lows, large["a"] == lows["k"]).select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("s")).select(F.col("s.x").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct()
        then, path_then = cut(small, "links")
        for old in (path, path_least, path_large, path_lows):
            discard(spark, old)
        now, path, before, mark = then, path_then, mark, _mark(then)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a block of links: every node's least reachable node."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(root), "component": [find(x) for x in root]})


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first())


def blocks(df: DataFrame, key: Column, row: Column, n_blocks: Column, pairs_only: bool = True) -> DataFrame:
    """Deals the rows of a large group over pairs of blocks, so that every two rows meet in some group of two blocks.

    Adds `g`, the group, `block`, the row's block, and `cross`, whether the group is of two blocks. With pairs_only a
    group of several blocks has no pair (i, i): its two blocks' rows meet each other in every group, so all pairs are
    seen.
    """
    d = df.withColumn("_k", key).withColumn("_n", n_blocks.cast("long")).withColumn("block", F.pmod(row, F.col("_n")))
    others = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    if pairs_only:
        others = F.when(F.col("_n") > 1, F.filter(others, lambda j: j != F.col("block"))).otherwise(others)
    k, own = F.col("_k"), F.col("block")
    group = F.transform(others, lambda j: F.struct(F.when(F.col("_n") == 1, k).otherwise(F.xxhash64(k, F.least(own, j), F.greatest(own, j))).alias("g"), (j != own).alias("cross")))
    return d.withColumn("_g", F.explode(group)).withColumns({"g": F.col("_g.g"), "cross": F.col("_g.cross")}).drop("_k", "_n", "_g")
