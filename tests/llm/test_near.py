import random
from collections import defaultdict

import numpy as np
import pytest

from shotplane.llm import common, embedding_dedup, minhash
from tests_llm_helpers import components, shingles


def test_shingles_as_defined():
    for t in ["", " \n", "a", "A b C", "a b c d e", "a b c d e f a b c d e", "É é\x0bX\x1cy z w v u"]:
        assert len(minhash.shingle_hashes(t.encode())) == len(shingles(t))
    assert (minhash.shingle_hashes(b"A B c") == minhash.shingle_hashes(b"a\tb  C")).all()


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    base = minhash.mix(r.integers(0, 1 << 60, 4000).astype(np.uint64))
    a, b = base[:2400], base[1600:]
    merged = np.maximum(minhash.sketch(a), minhash.sketch(b))
    assert (merged == minhash.sketch(base)).all()
    for share, ok in ((0.9, True), (0.5, False)):
        n, k = 1000, int(1000 * 2 * share / (1 + share))
        x, y = minhash.sketch(base[:n]), minhash.sketch(base[n - k : 2 * n - k])
        eq, up = np.array([(x == y).sum()]), np.array([(x > y).sum()])
        assert minhash.likely(up, 256 - eq - up, eq, n, np.array([float(n)]), 0.76)[0] == ok


def texts(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([3, 30, 120, 400]))]
        out.append(" ".join(base))
        for _ in range(r.randrange(6)):
            w = list(base)
            for _ in range(r.randrange(1, 5)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    common_part = " ".join(r.choice(words) for _ in range(60))
    out += [common_part + " " + " ".join(r.choice(words) for _ in range(40)) for _ in range(60)]
    base = [r.choice(words) for _ in range(200)]
    out += [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(0, 200, 2)]
    out += [out[0]] * 30 + ["", " ", "one two", "ONE  two", "x " * 5000]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("blocks", [(2048, 400_000), (16, 3000)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", blocks[0])
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", blocks[1])
    rows = [(i + 3, t) for i, t in enumerate(texts())] + [(5000, None), (None, "one two"), (5001, None)]
    d = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, n int, component long".replace("component long", "component string"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d, 85).collect()}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids} | {None: (1, None, True)}
    kept = [r.doc_id for r in minhash.drop_near_duplicates(d.withColumn("_id", d.n), 85).collect()]
    assert sorted(x for x in kept if x is not None) == [i for i in ids if comp[i] == i] and kept.count(None) == 1
    assert minhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(4)
    v = r.standard_normal((60, 16))
    near = [x + 0.12 * r.standard_normal(16) for x in v[:20] for _ in range(4)]
    chain = [v[30] + 0.02 * k * v[31] for k in range(40)]
    data = [x.tolist() for x in [*v, *near, *chain]] + [v[0].tolist()] * 9 + [(3 * v[1]).tolist()]
    rows = [(i + 10, x) for i, x in enumerate(data)] + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None, 1.0]), (1005, [1.0, 0.0]), (1006, [1.0, 0.1]), (None, data[0])]
    d = spark.createDataFrame([(*x, 3, "q") for x in rows], "vec_id long, embedding array<float>, n_links int, rep string")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_links(d).collect()}
    held = {i: np.asarray(x, np.float32).astype(float) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and np.any(x)}
    ids = sorted(i for i, _ in rows if i is not None)
    links = [(a, b) for a in held for b in held if a < b and len(held[a]) == len(held[b]) and held[a] @ held[b] >= 0.95 * np.linalg.norm(held[a]) * np.linalg.norm(held[b])]
    comp, n = components(ids, links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in ids} | {None: (0, None, True)}
    assert embedding_dedup.embedding_links(d.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 400)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == components({x for p in path + star for x in p}, path + star)


def test_other_ids_than_whole_numbers_are_refused(spark):
    d = spark.createDataFrame([("a", "x", [1.0])], "doc_id string, text string, embedding array<float>")
    for run in (lambda: minhash.near_duplicates(d), lambda: embedding_dedup.embedding_links(d.withColumnRenamed("doc_id", "vec_id"))):
        with pytest.raises(TypeError, match="whole number"):
            run()
