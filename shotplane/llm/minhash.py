"""Near duplicates by SetSketch registers of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.llm.common import blocks, components, cut, id_field, key_filter, map_batches, map_groups, passing, unused, whole_ids

#: Words of a shingle; the base and rate of the registers; registers, and registers of a band at 85 percent.
WORDS, BASE, RATE, REGISTERS, BAND = 5, 1.001, 20.0, 256, 8
#: Probability below which a pair at the threshold may share no band.
MISSED = 1e-4
#: Standard deviations below the threshold to which the likelihood's estimate may fall before a pair is dropped.
MARGIN = 4.0
#: Documents of a block of a bucket, and shingles of a block of a candidate component.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 400_000
#: Words whose hashes a worker remembers before it forgets them all.
MEMO = 150_000

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Words(dict):
    """Hashes of words, computed once."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(w)
        self[w] = h
        return h


_WORDS = _Words()


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: of the whole sequence where it has fewer words, none without
    words. Only A-Z are lowered, and words are cut at the six ASCII blanks."""
    w = text.lower().split()
    n = len(w)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(_WORDS.__getitem__, w), U64, n)
    k = min(words, n)
    out = np.zeros(n - k + 1, U64)
    for j in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j] + U64(k))
    return np.unique(out)


def _rounds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20))
    return r.integers(1, 1 << 32, registers, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, registers, dtype=np.uint32)


_A, _B = _rounds(1024)


def minima(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each register the least of the elements' 32-bit values under its own affine permutation."""
    x = (hashes >> U64(32)).astype(np.uint32)
    out = np.full(registers, 0xFFFFFFFF, np.uint32)
    a, b = _A[:registers, None], _B[:registers, None]
    for lo in range(0, len(x), 512):
        v = a * x[lo : lo + 512] + b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(1), out=out)
    return out


def to_registers(least: np.ndarray, base: float = BASE, rate: float = RATE) -> np.ndarray:
    """Registers from minima: a uniform minimum becomes an exponential one, whose power of the base is truncated."""
    u = (least.astype(np.float64) + 0.5) / 4294967296.0
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / rate) / np.log(base)) + 32768, 0, 65535).astype("<u2")


def sketch(hashes: np.ndarray, registers: int = REGISTERS, base: float = BASE, rate: float = RATE) -> np.ndarray:
    """The registers of a set: exponentially spaced, truncated minima. The registers of a union are the larger ones."""
    return to_registers(minima(hashes, registers), base, rate)


def band_size(percent: int, registers: int = REGISTERS) -> int:
    """The most registers of a band with which a pair at the threshold is missed with a probability below MISSED."""
    j = percent / 100
    return max((b for b in range(1, registers + 1) if (1 - j**b) ** (registers // b) < MISSED), default=1)


def band_keys(regs: np.ndarray, band: int = BAND) -> np.ndarray:
    parts = regs[: len(regs) // band * band].astype(U64).reshape(-1, band)
    h = np.arange(len(parts), dtype=U64)
    for j in range(band):
        h = mix(h * U64(0x9E3779B97F4A7C15) + parts[:, j] + U64(1))
    return h.view(np.int64)


def likely(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n: float, others: np.ndarray, j0: float, base: float = BASE) -> np.ndarray:
    """Whether the joint likelihood of the counts of larger, smaller and equal registers has its maximum at a
    similarity of j0 or more. It is concave in the similarity, so its slope at j0 tells."""
    u, v = n / (n + others), others / (n + others)
    c, ln = (base - 1) / base, np.log(base)
    top = np.minimum(j0, 0.999 * np.minimum(u / v, v / u))
    x, y = np.maximum(u - v * top, 1e-9), np.maximum(v - u * top, 1e-9)
    p, q = -np.log1p(-c * x) / ln, -np.log1p(-c * y) / ln
    dp, dq = -v * c / ((1 - c * x) * ln), -u * c / ((1 - c * y) * ln)
    slope = above * dp / p + below * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)
    return slope >= 0


def _spread(order: list[int], linked) -> np.ndarray:
    """Each row's root by breadth-first search: linked(i, rest) tells which of the rest are linked with i."""
    n = len(order)
    root = np.full(n, -1, np.int64)
    rest = np.array(order, np.int64)
    while len(rest):
        start, rest = rest[0], rest[1:]
        root[start] = start
        queue = [start]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            if hit.any():
                got = rest[hit]
                root[got] = start
                queue += got.tolist()
                rest = rest[~hit]
    return root


def _shared(a_lo: int, a_hi: int, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, rest: np.ndarray, mark: np.ndarray) -> np.ndarray:
    own = flat[a_lo:a_hi]
    mark[own] = 1
    if len(rest) * 4 > len(starts):
        total = np.concatenate([[0], np.cumsum(mark[flat], dtype=np.int64)])
        got = total[ends[rest]] - total[starts[rest]]
    else:
        got = np.array([int(mark[flat[starts[r] : ends[r]]].sum()) for r in rest.tolist()], np.int64)
    mark[own] = 0
    return got


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, registers: int = REGISTERS, band: int | None = None) -> DataFrame:
    """Groups documents that are linked by near-duplicate texts.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of word shingles. Returns a row for
    each row of docs (ids are whole numbers): doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id equals it).

    Texts without words (null, empty, blank) have empty sets and are linked with nothing. Rows without an id are linked
    with nothing, have no component and are kept. Rows that share an id are one document as far as links go. Other
    columns are left out.

    1. A worker makes each text's set, its digest and its registers. Equal sets become one representative (tasks combine
       them first), so a group of copies of any size costs one row.
    2. Bands of registers, as wide as the threshold allows (band_size), are counted; keys held by one representative only go, and of keys with the same members one
       stays. Within a bucket, blocks of representatives meet pair by pair of blocks, and joint likelihood of registers
       tells which may be similar; a spanning forest of these leaves the task, never all pairs.
    3. Within each component of candidates (only their texts, told by a filter of their ids, are moved) the full sets are
       compared, again block by block: an exact search by
       breadth, which skips pairs that are already connected. Its forest gives the components.
    """
    whole_ids(docs, "doc_id")
    docs = docs.select("doc_id", "text")
    band = band or band_size(percent, registers)
    j0 = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / registers) ** 0.5
    kinds = T.StructType([id_field(docs, "doc_id"), *(T.StructField(n, T.LongType()) for n in ("n", "fp", "fq")), T.StructField("regs", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, fq, regs, bands = [], [], [], [], []
            for x in b.column(1).to_pylist():
                h = shingle_hashes(x, words)
                n.append(len(h))
                data = h.tobytes()
                fp.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                fq.append(xxhash.xxh64_intdigest(data, 77) - (1 << 63))
                r = sketch(h, registers) if len(h) else None
                regs.append(None if r is None else r.tobytes())
                bands.append([] if r is None else band_keys(r, band))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(fq, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "fp", "fq", "regs", "bands"])
        _WORDS.clear()

    made, _ = cut(map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")), sketches, kinds), "sketches")
    sets = made.where("n > 0 and doc_id is not null")
    reps, _ = cut(sets.groupBy("fp", "fq", "n").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "representatives")

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep").bitwiseAND(0xFFFFFFFF)).alias("y")).where("size > 1")
    one = keys.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    members = keyed.join(one, "key")
    rows = members.join(reps.select("rep", "n", "regs"), "rep")
    met = blocks(rows, F.col("key"), F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK_DOCS)).select("g", "rep", "n", "regs")
    link = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def likely_links(t: dict) -> dict | None:
        rep, n = t["rep"], t["n"].astype(np.float64)
        if len(rep) < 2:
            return None
        regs = np.frombuffer(b"".join(t["regs"]), "<u2").reshape(len(rep), -1)

        def linked(i: int, rest: np.ndarray) -> np.ndarray:
            m = n[rest]
            hit = 100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])
            some = rest[hit]
            if len(some):
                eq = (regs[some] == regs[i]).sum(1)
                above = (regs[some] < regs[i]).sum(1)
                hit[hit] = likely(above, regs.shape[1] - eq - above, eq, n[i], n[some], j0)
            return hit

        root = _spread(np.argsort(rep, kind="stable").tolist(), linked)
        far = root != np.arange(len(rep))
        return {"a": rep[far], "b": rep[root[far]]} if far.any() else None

    near = components(map_groups(met, "g", likely_links, link).distinct())
    near, _ = cut(near, "candidates")

    weights = near.join(reps.select(F.col("rep").alias("node"), "n"), "node")
    total = weights.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("many"))
    large = total.select("component", F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("many") / BLOCK_DOCS)).alias("n_blocks")).where("n_blocks > 1")
    large, _ = cut(large, "large")
    dealt = weights.join(large, "component", "left").select("node", "component", F.coalesce("n_blocks", F.lit(1)).cast("long").alias("n_blocks"))
    asked, _ = cut(dealt.join(reps.select(F.col("rep").alias("node"), "fp", "fq"), "node"), "asked")
    known, _ = cut(key_filter(asked.select(F.xxhash64("node").alias("h"))), "asked-ids")
    texts = passing(docs.where("doc_id is not null"), F.xxhash64(F.col("doc_id").cast("long")), known).join(asked, docs["doc_id"] == asked["node"]).select("node", "component", "n_blocks", "fp", "fq", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spread = T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, keep = [], []
            fp, fq = b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, x in enumerate(b.column(5).to_pylist()):
                data = shingle_hashes(x, words).tobytes()
                if xxhash.xxh3_64_intdigest(data) - (1 << 63) == fp[i] and xxhash.xxh64_intdigest(data, 77) - (1 << 63) == fq[i]:
                    sets.append(data)
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at).cast(pa.int64()) for k in range(3)), pa.array(sets, pa.binary())], names=["node", "component", "n_blocks", "shingles"])
        _WORDS.clear()

    found = map_batches(texts, full_sets, spread)
    met = blocks(found, F.col("component"), F.xxhash64("node"), F.col("n_blocks")).select("g", "node", "shingles")

    def true_links(t: dict) -> dict | None:
        node = t["node"]
        if len(node) < 2:
            return None
        sizes = np.array([len(x) // 8 for x in t["shingles"]], np.int64)
        _, flat = np.unique(np.frombuffer(b"".join(t["shingles"]), U64), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        mark = np.zeros(len(flat) + 1, np.uint8)

        def linked(i: int, rest: np.ndarray) -> np.ndarray:
            m = sizes[rest]
            hit = 100 * np.minimum(m, sizes[i]) >= percent * np.maximum(m, sizes[i])
            some = rest[hit]
            if len(some):
                both = _shared(starts[i], ends[i], flat, starts, ends, some, mark)
                hit[hit] = 100 * both >= percent * (sizes[i] + sizes[some] - both)
            return hit

        root = _spread(np.argsort(node, kind="stable").tolist(), linked)
        far = root != np.arange(len(node))
        return {"a": node[far], "b": node[root[far]]} if far.any() else None

    linked = components(map_groups(met, "g", true_links, link).distinct())
    owner = reps.select("fp", "fq", "n", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "fq", "n", F.coalesce("component", "rep").alias("component"))
    out = made.select("doc_id", "n", "fp", "fq").join(owner, ["fp", "fq", "n"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("doc_id").isNull() | (comp == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: of each group the one with the smallest doc_id.

    Rows whose id is not dropped, as a filter of the dropped ids tells, are not moved.
    """
    (i,) = unused(docs, "_id")
    found, _ = cut(near_duplicates(docs, percent).where("doc_id is not null").select(F.col("doc_id").alias(i), "kept"), "near")
    dropped, _ = cut(found.groupBy(i).agg(F.bool_or("kept").alias("kept")).where("not kept").select(i), "dropped")
    words, _ = cut(key_filter(dropped.select(F.xxhash64(i).alias("h"))), "dropped-ids")
    h = F.xxhash64("doc_id")
    return passing(docs, h, words, inside=False).unionByName(passing(docs, h, words).join(dropped, F.col("doc_id") == F.col(i), "left_anti"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), k as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as k from w
), s as (
  select doc_id, len(k) as n, unnest(k) as s from k
), i as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as hit from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2, 3, 4
), half as (
  select a, b from i where 100 * hit >= 85 * (na + nb - hit)
), p as (
  select a, b from half union all select b, a from half
), r(a, b) as (
  select a, b from p union select r.a, p.b from r join p on r.b = p.a
), c as (
  select a, min(least(a, b)) as c from r group by 1
)
select doc_id, cast(len(k) as bigint) as n_shingles, coalesce(c, doc_id) as component_id, doc_id = coalesce(c, doc_id) as kept
from k left join c on k.doc_id = c.a
"""
