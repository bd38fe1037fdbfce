import random
import re
import zlib
from collections import Counter

import numpy as np

from shotplane.llm import language, toxicity

SYLLABLES = {"aa": "ka lo mi tu ra sen".split(), "bb": "vor esch gun tze bli ack".split(), "cc": "ñoa quei llé urr iza ble".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(n=300):
    r = random.Random(2)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        rows.append((i, prose(r, lang, r.randrange(20, 90)), lang))
    return rows


def brute_predict(text, profiles, size):
    def top(t):
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " " + " ".join(letters.split()) + " "
        grams = [c for c in s if c != " "]
        grams += [s[i : i + 2] for i in range(len(s) - 1)]
        grams += [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]
        return Counter(grams)

    return top(text), profiles, size


def test_grams_as_defined():
    want = brute_predict("Ab,  é1b", None, 0)[0]
    assert Counter(np.unique(language.grams("Ab,  é1b"), return_counts=True)[1].tolist()) == Counter(want.values())
    assert len(language.grams("12 . !")) == 0 and len(language.grams("")) == 0


def test_out_of_place_distance():
    p = language.Profiles({"x": [5, 7, 9], "y": [9, 11, 5]}, 3)
    assert p.langs == ["x", "y"]
    assert language.Profiles({}, 3).predict("abc") == ("und", 0.0)


def test_languages_of_held_out_rows(spark):
    rows = corpus() + [(1000, None, "aa"), (1001, "12 34", "bb"), (1002, "", None), (None, prose(random.Random(1), "cc", 40), "cc"), (1003, prose(random.Random(3), "aa", 60000), None)]
    d = spark.createDataFrame([(*x, "s", 0.5) for x in rows], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in language.identify(d, language.learn(d)).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == ("und" if not text or not any(c.isalpha() for c in text) else lang or "aa")
        assert 0 <= got[i].score <= 1
    empty = d.limit(0)
    assert language.identify(empty, language.learn(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(d, language.learn(empty)).collect()} == {"und"}


def test_prediction_equals_brute_force(spark):
    """Profiles counted and distances summed by hand, from n-grams as strings."""
    rows = corpus(60)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(d, language.learn(d, size=50)).collect()}
    code = lambda g: (ord(g) if len(g) == 1 else (0 if g[0] == " " else ord(g[0])) << 21 | (0 if g[1] == " " else ord(g[1])) | 1 << 62) if len(g) < 3 else ((0 if g[0] == " " else ord(g[0])) << 21 | ord(g[1])) << 21 | (0 if g[2] == " " else ord(g[2]))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:50]]
    count: dict[str, Counter] = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            count.setdefault(lang, Counter()).update(brute_predict(t, None, 0)[0])
    ranks = {k: {g: n for n, g in enumerate(top(c))} for k, c in count.items()}
    for i, t, _ in rows:
        mine = top(brute_predict(t, None, 0)[0])
        dist = {k: sum(abs(r[g] - n) if g in r else 50 for n, g in enumerate(mine)) for k, r in ranks.items()}
        assert got[i].lang_pred == min(sorted(dist), key=dist.get)


def toxic_corpus(spark, n=600):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = prose(r, "aa", r.randrange(20, 60)).split()
        bad = r.random() < 0.2
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["grunk", "Blarf!", "zornig", "zornelt", "zornar"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame([(*x, "t", 1.0) for x in rows], "doc_id long, text string, label string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_of_held_out_rows(spark):
    docs, labels, truth = toxic_corpus(spark)
    more = spark.createDataFrame([(9000, None), (9001, ""), (None, "blarf grunk")], "doc_id long, text string").selectExpr("doc_id", "text", "'t' label", "1D score")
    docs, labels = docs.union(more), labels.union(spark.createDataFrame([(None, 1), (5, None), (7777, 1)], labels.schema))
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[9000].score == got[9001].score < 0.5 and got[None].predicted == 1
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    model, _ = toxicity.learn(docs, labels)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_corpus(spark, 40)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in toxicity.classify(docs, some).collect()} == {0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def slow_label_model(votes, prior, belief, rounds):
    """Expectation maximisation document by document, and residuals as a matrix."""
    n, m = votes.shape
    sure, share = belief.copy(), np.ones(m)
    for r in range(rounds):
        p = np.zeros(n)
        for i in range(n):
            z = np.log(prior / (1 - prior))
            for j in np.flatnonzero(votes[i]):
                z += share[j] * (np.log(sure[j] / (1 - sure[j])) - np.log(prior / (1 - prior)))
            p[i] = 1 / (1 + np.exp(-z))
        fires = votes.sum(0)
        if r in (0, rounds // 2):
            hit, miss = (p @ votes) / p.sum(), ((1 - p) @ votes) / (1 - p).sum()
            rest = votes - np.outer(p, hit) - np.outer(1 - p, miss)
            cov = rest.T @ rest / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            rho = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(rho, 1)
            rho[rho < toxicity.TIED] = 0
            share = 1 / rho.sum(0)
        sure = np.clip((p @ votes + toxicity.BELIEF_DOCS * belief) / (fires + toxicity.BELIEF_DOCS), 1e-3, 1 - 1e-3)
    return sure, share


def test_label_model_equals_brute_force_and_ties_equal_voters(spark):
    r = np.random.default_rng(0)
    y = r.random(900) < 0.25
    one = (r.random(900) < 0.6) & y
    cols = [one, one, (r.random(900) < 0.97) & one, (r.random(900) < 0.5) & y, (r.random(900) < 0.05) | (y & (r.random(900) < 0.4)), ~y & (r.random(900) < 0.3)]
    votes = np.column_stack(cols).astype(float)
    belief = np.array([0.8] * 5 + [0.1])
    sets = Counter(tuple(np.flatnonzero(v).tolist()) for v in votes)
    rows = spark.createDataFrame([(list(k), c) for k, c in sets.items() if k], "at array<int>, n long").repartition(5)
    known = toxicity.label_model(rows, len(votes), 0.25, belief)
    sure, share = slow_label_model(votes, 0.25, belief, toxicity.ROUNDS)
    assert np.allclose(known["sure"], sure) and np.allclose(known["share"], share)
    assert known["share"][:3].max() < 0.4 and known["share"][3] == 1 and known["sure"][3] > 0.9 and known["sure"][5] < 0.25
    p = toxicity.posterior([np.flatnonzero(v) for v in votes], 0.25, known["sure"], known["share"])
    assert ((p >= 0.5) == y)[votes[:, :4].any(1)].mean() > 0.97
    assert np.allclose(p[~votes.any(1)], 0.25)


def test_scores_equal_the_definition(spark):
    docs, labels, _ = toxic_corpus(spark, 200)
    model, marked = toxicity.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {i: set(re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    places = {f: len(toxicity.FIXED) + k for k, f in enumerate(model.entries)}
    for r in toxicity.classify(docs, labels).collect():
        on = {places[f] for w in words[r.doc_id] for f in toxicity.word_features(w) if f in places}
        on |= {k for k, v in enumerate(toxicity.LEXICONS.values()) if words[r.doc_id] & set(v.split())}
        on |= {len(toxicity.LEXICONS) + k for k, p in enumerate(toxicity.PATTERNS.values()) if re.search(p, texts[r.doc_id])}
        assert abs(r.score - 1 / (1 + np.exp(-(model.bias + sum(model.weights[k] for k in on))))) < 1e-9
    assert marked.count() == 200
