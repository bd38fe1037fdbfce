"""Toxicity by weak supervision: a label model of many voters, and a linear classifier of its posterior labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.llm.common import cut, id_field, map_batches

#: Drawn documents (expected numbers): labelled ones from which lexicon entries are taken, and any from which the classifier
#: is learned. The classifier's features that are lexicon entries, and the first of them that vote.
TRAIN_DOCS, FEATURES, VOTERS = 12_000, 1024, 256
#: Documents with label 1 in which an entry must stand, how much more often than elsewhere, and, of the labelled documents
#: in which it stands and half a row more, the share with label 1 that an entry needs to vote.
LEAST, LIFT, PRECISE = 4, 4.0, 0.9
#: Lengths of word beginnings that stand for inflected words.
STEMS = (3, 4, 5, 6)
#: Rows whose crc32 of the id has remainder 0 by this modulus are held out (fixed value of the contract).
MODULUS = 5
#: What is assumed of a voter before its accuracy is estimated: how sure its vote is, and for how many documents that counts.
BELIEF, BELIEF_DOCS = 0.8, 2.0
#: Rounds of expectation maximisation, and the correlation from which two voters share their weight.
ROUNDS, TIED = 5, 0.5
#: Words a worker remembers before it forgets them all.
MEMO = 150_000

WORD = re.compile(r"[^\W\d_]+")
#: Voters that owe nothing to labels: lexicons, of which the last two vote for label 0, and patterns over the text as it is,
#: each of which starts with few characters, so that texts are skimmed.
LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb imbecile fool fools cretin dimwit halfwit brainless dummkopf blöd trottel imbécile débile idiota estúpido tonto",
    "worth": "worthless pathetic loser losers useless failure nobody wertlos versager minable inútil perdedor",
    "disgust": "disgusting scum trash filth filthy vermin garbage repulsive abschaum widerlich dégoûtant ordure escoria asqueroso basura",
    "ridicule": "clown clowns laughable ridiculous freak lächerlich ridicule ridículo payaso bouffon",
    "hate": "hate hateful despise hasse déteste odio",
    "threat": "kill töten tuer matar",
    "notice": "license licence licensed copyright",
    "courtesy": "please thank thanks bitte danke merci gracias",
}
PATTERNS = {
    "shouting": r"!!",
    "capitals": r"[A-Z](?<!\w.)[A-Z]{3,}\W+[A-Z]{4,}\W+[A-Z]{4,}\b",
    "masked": r"[*#@$](?<=[A-Za-z].)[*#@$]+[A-Za-z]",
    "address": r"[Yy]ou(?:'re| are) (?:a|an|such|so|all|nothing)\b",
}
FOR_0 = ("notice", "courtesy")
FIXED = [*LEXICONS, *PATTERNS]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % MODULUS == 0, F.lit(False))


def word_features(w: str) -> list[int]:
    """Hashes of a lexicon entry, the word, and of patterns, its beginnings."""
    return [xxhash.xxh3_64_intdigest("w" + w) - (1 << 63)] + [xxhash.xxh3_64_intdigest("p" + w[:k]) - (1 << 63) for k in STEMS if len(w) >= k]


class Marker(dict):
    """The places of a text's features: lexicons, patterns, then lexicon entries by hash. Words are looked up once."""

    def __init__(self, entries: list[int]):
        super().__init__()
        self.entries = {f: len(FIXED) + i for i, f in enumerate(entries)}
        self.lexicons: dict[str, list[int]] = {}
        for i, words in enumerate(LEXICONS.values()):
            for w in words.split():
                self.lexicons.setdefault(w, []).append(i)
        self.patterns = [(len(LEXICONS) + i, re.compile(p)) for i, p in enumerate(PATTERNS.values())]

    def __missing__(self, w: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        self[w] = got = (*self.lexicons.get(w, ()), *(self.entries[x] for x in word_features(w) if x in self.entries))
        return got

    def of(self, text: str) -> list[int]:
        out: set[int] = set()
        for w in set(WORD.findall(text.lower())):
            if f := self[w]:
                out.update(f)
        out.update(i for i, p in self.patterns if p.search(text))
        return sorted(out)


@dataclass
class Model:
    """A linear classifier over the features of a Marker, and what the label model estimated of its voters."""

    entries: list[int]
    weights: np.ndarray
    bias: float
    voters: dict[str, np.ndarray]

    @staticmethod
    def constant(bias: float) -> Model:
        return Model([], np.zeros(len(FIXED)), bias, {})

    def score(self, at: list[int]) -> float:
        z = self.bias + float(self.weights[at].sum()) if at else self.bias
        return 1 / (1 + float(np.exp(-np.clip(z, -40, 40))))


def logit(q):
    return np.log(q) - np.log1p(-q)


def posterior(fired: list[np.ndarray], prior: float, sure: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each set of voters that fire: each moves the prior's log odds by its share of what it is
    sure of (probability of label 1 where it fires) beyond the prior; a voter that is silent abstains and moves nothing."""
    w = share * (logit(sure) - logit(prior))
    z = logit(prior) + np.array([w[at].sum() for at in fired])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(patterns: DataFrame, n_docs: int, prior: float, belief: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Accuracies and correlations of voters, from how they fire together in all documents; labels have no part in it.

    `patterns` has a row for each set of voters that fired (at, n: how many documents); n_docs counts the silent ones, too.
    Expectation: the posterior of each set. Maximisation: how sure a voter is, the mean posterior where it fires, smoothed
    by `belief`. After the first and the middle round, correlations are those of the residuals, once the posterior's share
    is taken away; voters tied by TIED or more share their weight, each by the inverse of its summed correlations. Every
    round is one pass over the sets; what reaches the driver has the size of the voters' table.
    """
    m = len(belief)
    sure, share = belief.copy(), np.ones(m)
    sums = T.StructType([T.StructField(x, t) for x, t in (("j", T.IntegerType()), ("k", T.IntegerType()), ("n", T.DoubleType()), ("a", T.DoubleType()), ("b", T.DoubleType()))])

    def gathered(pairs: bool) -> dict[tuple[int, int], tuple[float, float, float]]:
        now = (prior, sure.copy(), share.copy())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = np.zeros((m + 1, 3)), np.zeros((m, m)) if pairs else None
            for b in batches:
                fired = [np.array(x, np.int64) for x in b.column(0).to_pylist()]
                n = b.column(1).to_numpy().astype(float)
                p = posterior(fired, *now)
                for at, c, q in zip(fired, n.tolist(), p.tolist()):
                    one[at] += (c, c * q, 0.0)
                    one[m] += (c, c * q, c * q * q)
                    if two is not None:
                        two[np.ix_(at, at)] += c
            j, k, v = list(range(m + 1)), [-1] * (m + 1), one
            if two is not None:
                x, y = np.nonzero(two)
                j, k = j + x.tolist(), k + y.tolist()
                v = np.concatenate([one, np.column_stack([two[x, y], np.zeros((len(x), 2))])])
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(k, pa.int32()), *(pa.array(v[:, i]) for i in range(3))], names=["j", "k", "n", "a", "b"])

        rows = map_batches(patterns.select("at", "n"), run, sums).groupBy("j", "k").agg(*(F.sum(x).alias(x) for x in ("n", "a", "b"))).collect()
        return {(r["j"], r["k"]): (r["n"], r["a"], r["b"]) for r in rows}

    for r in range(rounds):
        got = gathered(r in (0, rounds // 2))
        none = (0.0, 0.0, 0.0)
        n = np.array([got.get((j, -1), none)[0] for j in range(m)])
        a = np.array([got.get((j, -1), none)[1] for j in range(m)])
        sure = np.clip((a + BELIEF_DOCS * belief) / (n + BELIEF_DOCS), 1e-3, 1 - 1e-3)
        if r in (0, rounds // 2):
            some, p1, p2 = got.get((m, -1), none)
            silent = max(n_docs - some, 0.0)
            p1, p2 = p1 + silent * prior, p2 + silent * prior * prior
            total = max(n_docs, 1)
            hit, miss = a / max(p1, 1e-9), (n - a) / max(total - p1, 1e-9)
            both = np.zeros((m, m))
            for (j, k), x in got.items():
                if k >= 0:
                    both[j, k] = x[0]
            mean = np.outer(a, hit) + np.outer(n - a, miss)
            square = p2 * np.outer(hit, hit) + (p1 - p2) * (np.outer(hit, miss) + np.outer(miss, hit)) + (total - 2 * p1 + p2) * np.outer(miss, miss)
            cov = (both - mean - mean.T + square) / total
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            rho = np.clip(cov / np.outer(scale, scale), 0, 1)
            np.fill_diagonal(rho, 1)
            rho[rho < TIED] = 0
            share = 1 / rho.sum(0)
    return {"sure": sure, "share": share, "fires": n}


def fit_linear(x: np.ndarray, p: np.ndarray, l2: float = 0.05, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: accelerated gradient steps on columns scaled by how often they fire."""
    n = len(x)
    scale = np.append(1 / np.sqrt(np.maximum(x.mean(0), 1 / n)), 1.0).astype(np.float32)
    x = np.column_stack([x, np.ones(n, np.float32)]) * scale
    q = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        q = x.T @ (x @ q) / n
        top = float(np.linalg.norm(q))
        q /= top
    ridge = (l2 / n * scale**2).astype(np.float32)
    ridge[-1] = 0
    rate = 1 / (0.25 * 1.1 * top + float(ridge.max()))
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = np.log((p.sum() + 1) / ((1 - p).sum() + 1))
    v = w.copy()
    for t in range(steps):
        e = (1 / (1 + np.exp(-np.clip(x @ v, -40, 40))) - p).astype(np.float32)
        nw = v - rate * (x.T @ e / n + ridge * v)
        v = nw + t / (t + 3) * (nw - w)
        w = nw
    w = (w * scale).astype(np.float64)
    return w[:-1], float(w[-1])


def draw(part: float):
    """Whether a row is drawn, by a hash of its id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, part) * (1 << 30))


def lexicon_entries(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, features: int = FEATURES) -> tuple[list[int], list[bool], float] | float:
    """Words and word beginnings that stand more often in documents with label 1; for the fixed voters and then for these,
    whether each is precise enough to vote; and the share of label 1. A constant log odds where the labels tell nothing.

    No list of words exists for an invented or unlisted language, so labelled rows that are not held out choose the entries
    and admit voters; that and the class balance are all that labels are used for. A fixed voter that no labelled row holds
    is admitted. About train_docs labelled rows are drawn; words are counted by tasks, and
    the driver gets the best `features`. Labels that differ for an id are averaged. Ids must match labels.doc_id by value.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "toxic")
    n = marks.count()
    if not n:
        return -4.0
    marks = marks.where(draw(train_docs / n)).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("long").alias("y")).withColumnRenamed("doc_id", "_id")
    rows = docs.where(F.col("doc_id").isNotNull() & draw(train_docs / n)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marks, F.col("doc_id") == F.col("_id")).select("y", "text")
    kinds = T.StructType([T.StructField("f", T.LongType()), T.StructField("n1", T.LongType()), T.StructField("n0", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, list[int]] = {}
        fixed = Marker([])
        for b in batches:
            parts: tuple[list, list] = ([], [])
            for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(hashes) >= MEMO:
                    hashes.clear()
                f = {h for w in set(WORD.findall(x.lower())) for h in (hashes.get(w) or hashes.setdefault(w, word_features(w)))}
                f.update(fixed.of(x))
                parts[y].append(np.fromiter(f, np.int64, len(f)))
            for y, some in enumerate(parts):
                if some:
                    u, k = np.unique(np.concatenate(some), return_counts=True)
                    z = np.zeros(len(u), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u), *map(pa.array, (k.astype(np.int64), z) if y else (z, k.astype(np.int64)))], names=["f", "n1", "n0"])

    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = total.get(1, 0), total.get(0, 0)
    if not ones or not zeros:
        return -4.0 if zeros or not ones else 4.0
    least = min(LEAST, max(2, ones // 4))
    r1, r0 = (F.col("n1") + 0.1) / ones, (F.col("n0") + 0.5) / zeros
    own = F.col("f").between(0, len(FIXED) - 1)
    counts = map_batches(rows, count, kinds).groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(own | ((F.col("n1") >= least) & (r1 > LIFT * r0)))
    best = counts.orderBy(F.desc(own), F.desc(F.log(r1 / r0) * F.sqrt("n1")), "f").limit(features + len(FIXED)).collect()
    share = {r["f"]: r["n1"] / (r["n1"] + r["n0"] + 0.5) for r in best}
    prior = ones / (ones + zeros)
    admitted = [share.get(i, 0.0) <= prior / 2 if f in FOR_0 else share.get(i, 1.0) >= PRECISE for i, f in enumerate(FIXED)]
    entries = [r["f"] for r in best if not 0 <= r["f"] < len(FIXED)]
    return entries, admitted + [share[f] >= PRECISE for f in entries], prior


def mark(docs: DataFrame, entries: list[int]) -> DataFrame:
    """The places of the features in every whole text: doc_id, held_out, at. A null text counts as empty."""
    kinds = T.StructType([id_field(docs, "doc_id"), T.StructField("held_out", T.BooleanType()), T.StructField("at", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Marker(entries)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([known.of(x) for x in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "held_out", "at"])

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")), run, kinds)


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, features: int = FEATURES, voters: int = VOTERS) -> tuple[Model, DataFrame]:
    """Learns from all rows that are not held out, labelled or not; returns the model and the marked documents.

    1. Voters: fixed lexicons and patterns, and lexicon entries (lexicon_entries). Each votes for one label or abstains.
    2. One pass marks which of them stand in every text, and is written. The label model estimates voters from all marked
       rows that are not held out; equal sets of voters are one row with a count.
    3. The classifier is fitted to the posteriors of about train_docs drawn rows, labelled or not.
    """
    found = lexicon_entries(docs, labels, train_docs, features)
    entries, precise, prior = ([], [], 0.0) if isinstance(found, float) else found
    marked, _ = cut(mark(docs, entries), "marked")
    if isinstance(found, float):
        return Model.constant(found), marked
    prior = float(np.clip(prior, 0.001, 0.999))
    votes = [i for i, fine in enumerate(precise) if fine][: voters + len(FIXED)]
    place = {f: i for i, f in enumerate(votes)}
    belief = np.array([prior / 2 if i < len(FIXED) and FIXED[i] in FOR_0 else max(BELIEF, prior) for i in votes])
    seen = marked.where(~F.col("held_out"))
    to = F.create_map(*(F.lit(x) for f, i in place.items() for x in (f, i)))
    chosen = F.filter(F.transform("at", lambda f: F.element_at(to, f)), lambda i: i.isNotNull())
    patterns, _ = cut(seen.select(F.array_sort(chosen).alias("at")).where("size(at) > 0").groupBy("at").agg(F.count("*").alias("n")), "votes")
    n_docs = seen.count()
    known = label_model(patterns, n_docs, prior, belief)
    got = seen.where(F.col("doc_id").isNotNull() & draw(train_docs / max(n_docs, 1))).select("at").collect()
    sets = sorted(tuple(r["at"]) for r in got)
    if not sets:
        return Model.constant(float(logit(prior))), marked
    p = posterior([np.array([place[f] for f in at if f in place], np.int64) for at in sets], prior, known["sure"], known["share"])
    x = np.zeros((len(sets), len(FIXED) + len(entries)), np.float32)
    for i, at in enumerate(sets):
        x[i, list(at)] = 1
    w, b = fit_linear(x, p)
    return Model(entries, w, b, known | {"votes": np.array(votes)}), marked


def scored(at: Column, model: Model) -> Column:
    """A linear classifier's probability, over an array of places."""
    w = F.array(*(F.lit(float(x)) for x in model.weights))
    z = F.aggregate(at, F.lit(float(model.bias)), lambda s, i: s + F.get(w, i))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns, and scores every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    A null text counts as empty, which scores as a text without any feature. Rows stay as they are, repeated ids too;
    a null id is not held out. Only the text is read for a score. Other columns are left out.
    """
    model, marked = learn(docs, labels)
    s = marked.select("doc_id", "held_out", scored(F.col("at"), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, row by row."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Marker(model.entries)
        for b in batches:
            fine = pa.array([model.score(known.of(x or "")) < 0.5 for x in b.column(at).to_pylist()], pa.bool_())
            yield b.filter(fine)

    return map_batches(docs, run, docs.schema)
