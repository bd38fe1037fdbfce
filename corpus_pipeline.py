"""A corpus pipeline: toxicity, exact dedup, MinHash near-dedup, secret scans, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotplane.llm import dedup_exact, minhash, packing, secrets, toxicity
from shotplane.llm.common import cut, discard, scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text counts as empty; rows are decided one by one, so repeated rows
    and ids share their fate. Without a label 1 or 0 to learn from, the labels that are there decide all."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))[0])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the longest, then that of the smallest id. Null texts are equal to blank ones; a null id
    comes last."""
    return dedup_exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates that of the smallest id stays. Rows without an id or without words are linked with
    nothing and stay; rows that share an id are one document as far as links go. Ids are whole numbers."""
    return minhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and the parts linked with them, are replaced by a mark in the documents' texts. All rows stay; a null text
    stays null."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences, a row for each piece. A null text is an end token alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: A learned classifier and a tokenizer can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written as Parquet and read again by the next. A stage's own tables
    go once its result is written, and that once the next stage's is; those of the last stage stay with what is returned."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            docs, path = cut(made, name, keep=True)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
