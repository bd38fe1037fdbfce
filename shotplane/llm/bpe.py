"""Byte-level BPE encoding and decoding over a contiguous array of ranks."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.llm.common import id_field, map_batches
from shotplane.llm.token_counts import tokenizer_path

#: Words a worker remembers before it forgets them all, and the bytes of a word from which a heap replaces the scan.
MEMO, LONG = 200_000, 256
#: Characters whose class is alike in every Unicode version at hand; words of other texts are cut by the library.
SAFE = re.compile("[^\\x00-\\u0530\\u0900-\\u0bff\\u2000-\\u206f\\u20a0-\\u20bf\\u3000-\\u9fef\\uac00-\\ud7a3\\uff00-\\uffef\\U0001f300-\\U0001f64f]")
NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[bytes], dict[str, int]]:
    """The bytes of every id, and the special strings with their ids, of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    words = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for w, i in vocab.items():
        words[i] = bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode()
    for w, i in special.items():
        words[i] = w.encode()
    return words, special


class _Memo(dict):
    """Ids of words as bytes, encoded once each while they are remembered."""

    def __init__(self, word):
        super().__init__()
        self.word = word

    def __missing__(self, w: str) -> bytes:
        got = array("I", self.word(w.encode())).tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(w) <= 64:
            self[w] = got
        return got


class ByteBPE:
    """A byte-level BPE vocabulary, read from a tokenizers file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.path = path
        self.bytes_of, self.special = read_vocabulary(path)
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append(vocab[a + b])
        self.memo = _Memo(self.word)
        self._library = None

    def word(self, data: bytes) -> list[int]:
        """The ids of one word: its parts and the ranks of adjacent parts stand in two arrays. The least rank is found by
        a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no pair has a rank."""
        if len(data) > LONG:
            return self._long(data)
        get, first = self.rank.get, self.first
        parts = [first[b] for b in data]
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], NONE)
        return parts

    def _long(self, data: bytes) -> list[int]:
        """The same merges by a heap over linked parts, for words whose scans would be quadratic."""
        get = self.rank.get
        parts = [self.first[b] for b in data]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := get(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if text.isascii() or not SAFE.search(text):
            return self.words.findall(text)
        if self._library is None:
            from shotplane.llm.token_counts import load

            self._library = load(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.cuts.split(text) if self.cuts else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(b"".join(map(self.memo.__getitem__, self.pieces(part))))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def load_bpe(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of every whole text, and the text decoded from them: doc_id, ids (binary, little-endian unsigned 32-bit), decoded.

    A null text counts as empty. Rows stay as they are, repeated and null ids too; other columns are left out. Special
    strings in a text get their special ids.
    """
    path = path or tokenizer_path()
    schema = T.StructType([id_field(docs, "doc_id"), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for b in batches:
            ids = [bpe.encode_bytes(x) for x in b.column(1).to_pylist()]
            back = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, schema)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of encode_documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or tokenizer_path()
    schema = T.StructType([id_field(docs, "doc_id"), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for b in batches:
            n, ids, back = [], [], []
            for x in b.column(1).to_pylist():
                data = bpe.encode_bytes(x)
                n.append(len(data) // 4)
                ids.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(bpe.decode(np.frombuffer(data, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, schema)
