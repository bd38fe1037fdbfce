"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.llm.common import id_field, map_batches

#: Entries of a profile, and the documents of a language from which its profile is learned (an expected number).
PROFILE, TRAIN_DOCS = 400, 2000
#: Rows whose crc32 of the id has this remainder by this modulus are held out (fixed values of the contract).
MODULUS, HELD = 3, 1
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % MODULUS == HELD, F.lit(False))


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three characters of a text's lowered words, padded by a blank on either side."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    c = np.where(letter_table()[c], c, 0)
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.empty(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 0]
    return np.concatenate([c[c != 0], two | 1 << 62, three])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, smaller codes first among equals."""
    u, n = np.unique(codes, return_counts=True)
    return u[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    """Profiles of languages, laid out as one table of ranks."""

    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(ranks), size
        self.codes = np.array(sorted({c for r in ranks.values() for c in r}), np.int64)
        self.table = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.table[np.searchsorted(self.codes, np.array(ranks[lang], np.int64)), j] = np.arange(len(ranks[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        """The language at the least out-of-place distance (the first by name among equals), and how sure that is: the
        next distance's share of both."""
        top = ranked(grams(text), self.size)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rank = self.table[np.where(self.codes[at] == top, at, len(self.codes))]
        off = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None])).sum(0)
        best = int(off.argmin())
        if len(off) == 1:
            return self.langs[best], 1.0
        next_one = float(np.partition(off, 1)[1])
        return self.langs[best], next_one / (next_one + float(off[best])) if next_one else 0.5


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles from the text and lang of rows that are not held out.

    Each language gives about train_docs documents, drawn by a hash of their ids, so what is gathered is bounded by the
    number of languages, whatever the input's size. Counts are summed by tasks before they are shuffled; only each
    language's most frequent n-grams reach the driver.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return Profiles({}, size)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.create_map(*(F.lit(x) for k, n in many.items() for x in (k, int(min(1.0, train_docs / n) * (1 << 30)))))
    some = rows.where(draw < F.element_at(bound, F.col("lang"))).select("lang", "text")
    kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counts = map_batches(some, count, kinds).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranks: dict[str, list[int]] = {}
    for r in counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).collect():
        ranks.setdefault(r["lang"], []).append((r["r"], r["code"]))
    return Profiles({lang: [c for _, c in sorted(x)] for lang, x in ranks.items()}, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Predicts the language of every whole text: doc_id, held_out, lang_pred, score.

    A document's most frequent n-grams are compared with each profile by out-of-place distance: the sum of differences
    in rank, n-grams that a profile lacks costing its size. Texts that are null or have no letter get `und` and 0. Rows
    stay as they are, repeated ids too; a null id is not held out. Only the text is read for a prediction.
    """
    kinds = T.StructType([id_field(docs, "doc_id"), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profiles.predict(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")), run, kinds)
