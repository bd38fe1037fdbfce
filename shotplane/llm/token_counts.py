"""Token counts, with overlap resynchronisation for huge texts."""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.llm.common import id_field, map_batches

#: Characters of a text that are encoded at once, and the overlap of two chunks before it is widened.
CHUNK, OVERLAP = 1 << 16, 1 << 9

_LOADED: dict[str, object] = {}
_FAST: dict[str, Callable[[str], np.ndarray]] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def fast_encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids by the ranks of a tokenizers file: the same ids as the tokenizers library's, from a
    quicker one. It holds a whole text's pieces at once, so long texts go through encode_spliced."""
    if path not in _FAST:
        import public_tokenizers
        import tiktoken

        from shotplane.llm.bpe import read_vocabulary

        words, special = read_vocabulary(path)
        plain = {w: i for i, w in enumerate(words) if i not in special.values()}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens=special)
        _FAST[path] = lambda text: fast.encode_to_numpy(text, allowed_special="all")
    return _FAST[path]


def stable(text: str, p: int) -> bool:
    """Whether every encoding that holds the two characters around p starts a piece at p.

    A single space after a visible character and before another one always opens a piece of the byte-level pattern, which
    looks only ahead, and no added token holds a space. So what follows p encodes alike wherever the chunk began.
    """
    return 0 < p < len(text) - 1 and text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()


def encode_spliced(encode: Callable[[str], tuple[list[int], list[int]]], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text from overlapping chunks.

    encode returns a chunk's ids and the character offsets at which they start. Two chunks are spliced at a boundary that
    both have and that is stable; where their overlap has none, it is widened twofold, and once it reaches the left
    chunk's start, that chunk itself is made twice as long. The result is that of the whole text.
    """
    ids: list[int] = []
    at, size = 0, chunk
    while True:
        end = min(len(text), at + size)
        left, starts = encode(text[at:end])
        if end == len(text):
            return ids + left
        wide, joint = overlap, None
        while joint is None and wide < end - at:
            begin = end - wide
            right, rights = encode(text[begin : min(len(text), begin + wide + overlap)])
            known = set(rights)
            for p in reversed(starts[bisect_left(starts, begin - at) :]):
                if p + at - begin in known and p > 0 and stable(text, p + at) and p + at + 1 < end:
                    joint = p
                    break
            wide *= 2
        if joint is None:
            size *= 2
            continue
        ids += left[: bisect_left(starts, joint)]
        at, size = at + joint, chunk


def encoder(path: str) -> Callable[[str], tuple[list[int], list[int]]]:
    t = load(path)

    def encode(text: str) -> tuple[list[int], list[int]]:
        e = t.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets]

    return encode


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes and tokens. Rows stay as they are, repeated ids and null ids too; other columns
    are left out. Texts of up to `chunk` characters are encoded at once by their ranks, longer ones in overlapping chunks
    by the library, whose offsets show where chunks may be spliced; it is loaded once such a text comes.
    """
    path = path or tokenizer_path()
    schema = T.StructType([id_field(docs, "doc_id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = fast_encoder(path)
        for b in batches:
            n = [len(short(x)) if len(x) <= chunk else len(encode_spliced(encoder(path), x, chunk, overlap)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    return map_batches(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")), run, schema)
