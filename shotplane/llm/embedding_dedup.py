"""Near-duplicate embeddings by Euclidean p-stable hashing."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.llm.common import blocks, components, cut, map_batches, map_groups, whole_ids
from shotplane.llm.minhash import U64, _spread, mix

#: Width of a projection's cell. Unit vectors at cosine 0.95 are 0.316 apart and share a cell with probability NEAR,
#: orthogonal ones with probability FAR.
WIDTH, NEAR, FAR = 2.0, 0.8738, 0.4862
#: The chance that a pair at cosine 0.95 shares no table.
MISS = 0.0004
#: Tables in which a vector meets one orthogonal vector by chance: more of them cost keys, fewer cost whole vectors.
CHANCE = 8
#: Vectors of a block of a bucket.
BLOCK = 1024


def layout(n: int) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors: so many projections that a vector shares a table with an orthogonal
    one about once in CHANCE tables, and so many tables that pairs at the threshold are missed with probability MISS."""
    k = max(8, math.ceil(math.log(CHANCE * max(n, 2)) / -math.log(FAR)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(NEAR**k)))


@lru_cache(4)
def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64([3, dim]))
    return r.standard_normal((dim, tables * k)), r.random(tables * k)


def table_keys(unit: np.ndarray, k: int, tables: int, width: float = WIDTH) -> np.ndarray:
    """For each unit vector its bucket in every table: quantised random projections, hashed with the table's number."""
    a, b = projections(unit.shape[1], k, tables)
    cells = np.floor(unit @ a / width + b).astype(np.int64).astype(U64).reshape(len(unit), tables, k)
    h = np.broadcast_to(np.arange(tables, dtype=U64) + U64(1000 * unit.shape[1]), (len(unit), tables)).copy()
    for j in range(k):
        h = mix(h * U64(0x9E3779B97F4A7C15) + cells[:, :, j] + U64(1))
    return h.view(np.int64)


def unit(v: np.ndarray) -> np.ndarray:
    """A finite vector, not zero, at length 1 in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def embedding_links(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Links vectors whose cosine, in double precision, is at least the threshold, and groups them.

    Returns a row for each row of vectors (vec_id, a whole number, and embedding): vec_id, n_links (other vectors linked directly),
    component_id (the smallest vec_id reachable by links), kept (vec_id equals it). Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, nor do vectors of different lengths. Rows without an id
    link with nothing, have no component and are kept; rows that share an id are one item as far as links go. Other
    columns are left out.

    Equal vectors become one representative with a count. Vectors are bucketed in many tables; keys of one member go, and
    of keys with the same members one stays. In a bucket, pairs of blocks are compared by exact cosines. A pair is
    counted only in the first of the buckets that it shares, and what leaves a task is a count and a root for each of
    its vectors, never its pairs.
    """
    whole_ids(vectors, "vec_id")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, width = ("array<float>", np.float32) if single else ("array<double>", np.float64)
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    usable = rows.where(fine)
    reps, _ = cut(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    shape = layout(reps.count())
    kinds = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType(), False))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.values.to_numpy(zero_copy_only=False) for x in b.column(2)]
            units = [unit(v) for v in raw]
            keys: list = [None] * len(units)
            for dim in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dim]
                for i, k in zip(at, table_keys(np.stack([units[i] for i in at]), *shape)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "n", "vector", "keys"])

    made, _ = cut(map_batches(reps.select(F.col("rep").cast("long").alias("rep"), "n", "embedding"), hashed, kinds), "hashed")
    keyed = made.select("rep", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep").bitwiseAND(0xFFFFFFFF)).alias("y")).where("size > 1")
    one = sizes.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    members, _ = cut(keyed.join(one, "key"), "members")
    own = members.groupBy("rep").agg(F.sort_array(F.collect_list("key")).alias("own"))
    rich = members.join(made.select("rep", "n", "vector"), "rep").join(own, "rep")
    dealt = blocks(rich, F.col("key"), F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK), pairs_only=False)
    met = dealt.select("g", "key", "block", F.col("cross").cast("long").alias("cross"), "rep", "n", "vector", "own")
    out = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])

    def compare(t: dict) -> dict | None:
        rep, n, block, own = t["rep"], t["n"], t["block"], t["own"]
        if len(rep) < 2:
            return None
        x = np.stack([unit(v) for v in np.frombuffer(b"".join(t["vector"]), width).reshape(len(rep), -1)])
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        if t["cross"][0]:
            hit &= block[:, None] != block[None, :]
        at = np.flatnonzero(hit.any(1))
        if not len(at):
            return None
        sub, key = hit[np.ix_(at, at)], int(t["key"][0])
        fresh = sub.copy()
        before = [set(own[i][: int(np.searchsorted(own[i], key))]) for i in at.tolist()]
        for k in [k for k, held in Counter(chain.from_iterable(before)).items() if held > 1]:
            has = np.fromiter((k in s for s in before), bool, len(at))
            fresh &= ~(has[:, None] & has[None, :])
        links = fresh @ n[at]
        root = _spread(np.argsort(rep[at], kind="stable").tolist(), lambda i, rest: sub[i, rest])
        return {"rep": rep[at], "links": links.astype(np.int64), "root": rep[at][root]}

    found, _ = cut(map_groups(met, "g", compare, out), "links")
    grouped = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.join(links, "rep", "left").join(grouped, "rep", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    none = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_rows = usable.join(known, "embedding").select("vec_id", "n_links", "component_id").unionByName(none)
    return all_rows.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))


ORACLE = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null and vec_id is not null
), p as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) as (
  select a, b from p union select r.a, p.b from r join p on r.b = p.a
), c as (
  select a, min(least(a, b)) as c from r group by 1
), n as (
  select a, count(*) as n from p group by 1
)
select vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(c.c, vec_id) as component_id, vec_id = coalesce(c.c, vec_id) as kept
from embeddings e left join n on e.vec_id = n.a left join c on e.vec_id = c.a
"""
