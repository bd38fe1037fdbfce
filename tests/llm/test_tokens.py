import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shotplane.llm import bpe, packing, token_counts

TEXTS = ["", " ", "hello world", "a  b\n\n c", "<|endoftext|> x<|endoftext|>", "été à Zürich 北京 42's", "x" * 700, "ab " * 900, " \t\n" * 50, "՘꟎ 1", "🙂🙂 don't WE'LL", "0123456789 " * 300]


def library(texts):
    return [e.ids for e in token_counts.load(token_counts.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, n_tokens int, ids string")


def test_spliced_encoding_equals_whole():
    encode = token_counts.encoder(token_counts.tokenizer_path())
    texts = [*TEXTS, "the cat sat on the mat, 12 times. " * 40, "".join(chr(97 + i % 26) + " " * (i % 3) for i in range(900)), "a" * 500 + " b" * 300]
    for x, want in zip(texts, library(texts)):
        for chunk, overlap in ((32, 4), (64, 16), (100, 50)):
            assert token_counts.encode_spliced(encode, x, chunk, overlap) == want


def test_counts_with_nulls_ties_and_extra_columns(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, None), (None, "a b"), (3, None)]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs(spark, rows), chunk=64, overlap=8).collect()}
    want = {(i, len((x or "").encode()), n := len(ids), n > 1024) for (i, x), ids in zip(rows, library([x or "" for _, x in rows]))}
    assert got == want
    assert token_counts.count_tokens(docs(spark, rows[:0])).count() == 0


def test_own_bpe_equals_the_library():
    b = bpe.load_bpe(token_counts.tokenizer_path())
    lib = token_counts.load(token_counts.tokenizer_path())
    long = ["ab" * 400, "aé" * 333, "=" * 1000]
    for x, want in zip([*TEXTS, *long], library([*TEXTS, *long])):
        assert b.encode(x) == want
        assert b.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_safe_characters_are_cut_alike():
    b = bpe.load_bpe(token_counts.tokenizer_path())
    lib = token_counts.load(token_counts.tokenizer_path()).pre_tokenizer
    for c in range(0x1F700):
        if not 0xD800 <= c < 0xE000 and not bpe.SAFE.search(chr(c)):
            s = f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}! {chr(c)}  {chr(c)} x"
            assert b.words.findall(s) == [s[i:j] for _, (i, j) in lib.pre_tokenize_str(s)], hex(c)


def test_digests(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(99, None)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs(spark, rows)).collect()}
    for (i, x), ids in zip(rows, library([x or "" for _, x in rows])):
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_is_whole_and_tight(spark, capacity):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(99, None), (5, "twice"), (5, "twice"), (None, "no id")] + [(1000 + i, "word " * (i * 7 % 50)) for i in range(400)]
    ids = [[*x, 2] for x in library([x or "" for _, x in rows])]
    d = docs(spark, rows).repartition(9)
    out = packing.pack(d, capacity=capacity, fan_in=2).collect()
    by_bin = defaultdict(list)
    for r in out:
        by_bin[r.sequence_id].append((r.offset, r.length))
    for parts in by_bin.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    want = sorted((i if i is not None else -1, k, a, n, zlib.crc32(np.asarray(x[a : a + n], "<u4").tobytes())) for (i, _), x in zip(rows, ids) for k, (a, n) in enumerate(packing.cut_pieces(len(x), capacity)))
    assert want == sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    whole = packing.best_fit(np.array([n for x in ids for _, n in packing.cut_pieces(len(x), capacity)]), capacity)[2]
    assert len(by_bin) <= len(whole) + 9, (len(by_bin), len(whole))  # one a partition at most
    assert packing.pack(d.limit(0)).count() == 0


def test_fast_encoder_equals_the_library():
    r = random.Random(8)
    letters = [*map(chr, range(0x20, 0x180)), *(chr(r.randrange(0x180, 0xD800)) for _ in range(200)), *(chr(r.randrange(0xE000, 0x11000)) for _ in range(60)), "\n", "\t", "\r\n", "   ", "<|endoftext|>", "'s", "'LL", "​", "́", "\U0001f600", "\x00", "\x85"]
    texts = ["".join(r.choices(letters, k=r.randrange(1, 50))) for _ in range(4000)] + TEXTS
    fast = token_counts.fast_encoder(token_counts.tokenizer_path())
    assert [fast(x).tolist() for x in texts] == library(texts)


def test_merging_some_bins_of_a_fill_equals_merging_all(spark):
    """Many underfull bins: the rounds end with as few as best fit over all bins of a group gives."""
    r = random.Random(2)
    fills = [r.choice([601, 640, 700, 550, 900, 130, 420, 380]) for _ in range(600)]
    small = [f for f in fills if f <= 512]
    rows, part = [], 0
    for k, f in enumerate(f for f in fills if f > 512):
        rows.append((k, f, k % 16))
    rows += [(10_000 + p, small[p], p) for p in range(16)]  # at most one small bin a part
    d = spark.createDataFrame(rows, "bin long, fill long, part long")
    got = {x.bin: (x.target, x.shift) for x in packing.merge_rounds(d, 1024, 2, 4).collect()}
    assert len(got) == len(rows)
    fill, by = {b: f for b, f, _ in rows}, defaultdict(list)
    for b, (t, s) in got.items():
        by[t].append((s, fill[b]))
    for items in by.values():
        at = 0
        for s, n in sorted(items):
            assert s == at
            at += n
        assert at <= 1024
    now = {p: [f for b, f, q in rows if q == p] for p in range(16)}
    while len(now) > 1:
        now = {p: [f for q in range(4 * p, 4 * p + 4) for f in now.get(q, [])] for p in range(-(-len(now) // 4))}
        for p, f in now.items():
            open_, closed = [x for x in f if x < 1022], [x for x in f if x >= 1022]
            now[p] = packing.best_fit(np.array(open_), 1024)[2] + closed
    assert len(by) == len(now[0])
