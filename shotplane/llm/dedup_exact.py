"""Exact duplicates by a log-structured merge index of digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane.llm.common import cut, discard, key_filter, passing, scratch, unused

#: What is deleted before texts are compared (a fixed value of the contract).
BLANKS = r"[\x20\x09-\x0D]+"
#: Runs that a round of compaction merges into one.
FAN_IN = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def itself(norm: Column) -> Column:
    return norm


class DigestIndex:
    """A log-structured index of text digests.

    - Memtables: `flush` reads documents; every task sorts its rows by digest, in a buffer that spills, and writes them
      as one sorted run. So a run is as large as a task's share of the input, and there are as many as tasks.
    - Filter: one bitmap over all runs tells which digests may stand more than once. Entries which it does not hold
      are unique: they are neither merged nor looked up.
    - Compaction: of the entries that pass, each round merges FAN_IN runs into one that is sorted, too, until one is left.
      Of equal digests it keeps the smallest entry (most code points, then smallest id, then first row) and their number.
    - Verification: the bytes of all texts whose digest stands more than once are compared.

    `digest` makes the key of a normalised text. Any function will do: if texts collide, `verified` says so.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Callable[[Column], Column] = sha256, fan_in: int = FAN_IN):
        self.spark, self.digest, self.fan_in = spark, digest, fan_in
        self.path = path or f"{scratch(spark).rstrip('/')}/shotplane/digests-{uuid.uuid4().hex}"
        self.runs = 0
        self.rounds: list[int] = []
        self._flushed: list[tuple[str, DataFrame]] = []
        self._words: DataFrame | None = None

    def flush(self, docs: DataFrame) -> None:
        """Adds documents (doc_id, text): one sorted run a task."""
        docs = docs.select("doc_id", "text")
        norm = normalised(F.col("text"))
        sha = [] if self.digest is sha256 else [sha256(norm).alias("sha")]
        rows = docs.select("doc_id", self.digest(norm).alias("digest"), *sha, F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), (F.spark_partition_id().cast("long") + self.runs).alias("run"), (F.monotonically_increasing_id() + (self.runs << 33)).alias("row"))
        at = f"{self.path}/flush-{len(self._flushed)}"
        rows.sortWithinPartitions("digest").write.parquet(at)
        self._flushed.append((at, docs))
        self._words = None
        self.runs = max(self.runs, (self.rows().agg(F.max("run")).first()[0] or 0) + 1)

    def rows(self) -> DataFrame:
        """All entries as they were flushed: doc_id, digest, n_points, run, row."""
        return self.spark.read.parquet(*(at for at, _ in self._flushed))

    def filter(self) -> DataFrame:
        if self._words is None:
            self._words, _ = cut(key_filter(self.rows().select(F.xxhash64("digest").alias("h")), repeated=True), "filter")
        return self._words

    def compact(self) -> DataFrame:
        """Merges the runs in rounds. Returns the digests with several entries: digest, best (the entry that stays), n."""
        best = F.struct((-F.col("n_points")).alias("o"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), "row")
        now = passing(self.rows(), F.xxhash64("digest"), self.filter()).select("run", "digest", best.alias("best"), F.lit(1).cast("long").alias("n"))
        left, old, self.rounds = self.runs, None, []
        while True:
            merged = now.groupBy(F.floor(F.col("run") / self.fan_in).alias("run"), "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
            now, path = cut(merged.sortWithinPartitions("run", "digest"), "run")
            if old:
                discard(self.spark, old)
            left, old = -(-left // self.fan_in), path
            self.rounds.append(left)
            if left <= 1:
                return now.where("n > 1").select("digest", "best", "n")

    def suspects(self, groups: DataFrame) -> DataFrame:
        """A filter of the ids of rows that have a digest of compact(): the others need no look at their texts."""
        rows = passing(self.rows(), F.xxhash64("digest"), self.filter())
        words, _ = cut(key_filter(rows.join(groups.select("digest"), "digest", "left_semi").select(F.xxhash64("doc_id").alias("h"))), "suspects")
        return words

    def verified(self, words: DataFrame) -> bool:
        """Whether all texts of one digest have the same bytes. Only texts of suspects are read; tasks combine equal bytes
        before they are shuffled, so a large group of copies sends one text a task."""
        docs = reduce(DataFrame.unionByName, (d for _, d in self._flushed))
        texts = passing(docs, F.xxhash64("doc_id"), words).select(normalised(F.col("text")).alias("norm")).groupBy("norm").agg(F.lit(1).alias("one"))
        return not texts.groupBy(self.digest(F.col("norm")).alias("digest")).agg(F.count("*").alias("n")).where("n > 1").take(1)


def _settled(docs: DataFrame, index: DigestIndex) -> tuple[DigestIndex, DataFrame, DataFrame]:
    """The index with the documents, its groups and suspects; where digests collide, an index keyed by the texts
    themselves, which can't."""
    index.flush(docs)
    groups = index.compact()
    words = index.suspects(groups)
    if index.verified(words):
        return index, groups, words
    exact = DigestIndex(index.spark, digest=itself, fan_in=index.fan_in)
    for _, d in index._flushed:
        exact.flush(d)
    groups = exact.compact()
    return exact, groups, exact.suspects(groups)


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Finds documents whose texts are equal once blanks are deleted, and names the one of each group that stays.

    Returns a row for each row of docs (and of what the index held before): doc_id, keep_id, group_size, kept,
    text_sha256. Of equal texts, the row with the most code points, then the smallest doc_id stays; of rows that tie in
    both, as repeated rows do, just one. Null texts count as empty, so they form one group with empty and blank texts. A
    null id is last among ties. Other columns are left out.
    """
    index, groups, _ = _settled(docs, index or DigestIndex(docs.sparkSession))
    rows = index.rows()
    sha, h = F.col("sha" if "sha" in rows.columns else "digest").alias("text_sha256"), F.xxhash64("digest")
    alone = passing(rows, h, index.filter(), inside=False).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    found = passing(rows, h, index.filter()).join(groups, "digest", "left")
    many = F.col("n").isNotNull()
    return alone.unionByName(found.select("doc_id", F.when(many, F.col("best.id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.when(many, F.col("row") == F.col("best.row")).otherwise(True).alias("kept"), sha))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, one row for each group of equal texts.

    It is the row that exact_duplicates keeps; of rows that tie in length and id, any one. Rows whose id no group has stay
    where they are; only the others are joined with their groups.
    """
    index, groups, words = _settled(docs, DigestIndex(docs.sparkSession))
    k, p, d, b = unused(docs, "_key", "_points", "_digest", "_best")
    h = F.xxhash64("doc_id")
    norm = normalised(F.col("text"))
    near = passing(docs, h, words).withColumns({k: index.digest(norm), p: F.char_length(F.coalesce("text", F.lit(""))).cast("long")})
    near = near.join(groups.select(F.col("digest").alias(d), F.col("best").alias(b)), F.col(k) == F.col(d), "left")
    is_best = F.col("doc_id").eqNullSafe(F.col(f"{b}.id")) & (F.col(p) == -F.col(f"{b}.o"))
    ties = passing(index.rows(), F.xxhash64("digest"), index.filter()).join(groups, "digest").where("doc_id <=> best.id and n_points = -best.o and row <> best.row")
    if ties.take(1):
        stay = near.where(F.col(d).isNull()).unionByName(near.where(F.col(d).isNotNull() & is_best).dropDuplicates([k]))
    else:
        stay = near.where(F.col(d).isNull() | is_best)
    return passing(docs, h, words, inside=False).unionByName(stay.select(*docs.columns))


ORACLE = """
with n as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as norm from documents
), r as (
  select doc_id, norm,
    first_value(doc_id) over (partition by norm order by length(t) desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
    count(*) over (partition by norm) as group_size
  from n
)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r
"""
