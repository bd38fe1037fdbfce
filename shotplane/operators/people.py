"""Faces as people: clustering, recognition, and a library of named people."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotplane.config import PeopleConfig
from shotplane.functions.vectors import centroids
from shotplane.operators.graph import blocks, components, cut

FACE_KEY = ["folder", "file", "face_idx"]
#: Vectors of a block when many are compared with many.
BLOCK = 1024
#: Letters that names may differ in (fixed values): only A-Z have another case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_faces(faces: DataFrame, cfg: PeopleConfig = PeopleConfig()) -> DataFrame:
    """Faces fit for identity with their part: core (clear and present) or weak. Others are left out."""
    core = (F.col("embed_norm") >= cfg.core_norm) & (F.col("presence") >= cfg.core_presence)
    return faces.where((F.size("embed") > 0) & (F.col("embed_norm") >= cfg.weak_norm)).withColumn("part", F.when(core, "core").otherwise("weak"))


def wide_enough(faces: DataFrame, cfg: PeopleConfig = PeopleConfig()) -> DataFrame:
    """Faces (with a box `w` pixels wide) that are wide enough to be identified."""
    return faces.where(F.col("w") >= cfg.min_width)


def sheet(members: DataFrame, columns: int = 16) -> DataFrame:
    """The first faces of each person in order, for a row of a contact sheet: a limit that is the sheet's width."""
    w = Window.partitionBy("folder", "person_id").orderBy("ord", "file", "face_idx")
    return members.withColumn("column", F.row_number().over(w)).where(F.col("column") <= columns)


def similar_pairs(faces: DataFrame, threshold: float, within: str = "folder", block: int = BLOCK, forest: bool = False) -> DataFrame:
    """Pairs of a folder's faces whose inner product is over the threshold, each once, with it.

    Blocks of a folder's faces meet two by two and are multiplied as matrices; only pairs over the threshold are made. With
    `forest` a group of blocks returns only as many of its pairs as connect what all of them connect, fewer than faces.
    """
    d = faces.select(F.col(within).alias("folder"), "file", "face_idx", F.col("embed").cast("array<double>").alias("embed"))
    many = d.groupBy("folder").agg(F.count("*").alias("_many"))
    row = F.xxhash64("file", "face_idx")
    dealt = blocks(d.join(many, "folder"), F.xxhash64("folder"), row, F.ceil(F.col("_many") / block), pairs_only=False)
    f, i = d.schema["file"].dataType, d.schema["face_idx"].dataType
    schema = T.StructType([d.schema["folder"], T.StructField("file_a", f), T.StructField("face_idx_a", i), T.StructField("file_b", f), T.StructField("face_idx_b", i), T.StructField("sim", T.DoubleType())])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["embed"].to_numpy())
        sim = v @ v.T
        hit = np.triu(sim > threshold, 1)
        own = pdf["block"].to_numpy()
        if pdf["cross"].iloc[0]:
            hit &= own[:, None] != own[None, :]
        a, b = spanning(hit) if forest else np.nonzero(hit)
        key = list(zip(pdf["file"], pdf["face_idx"]))
        swap = np.fromiter((key[x] > key[y] for x, y in zip(a, b)), bool, len(a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        col = lambda c, at: pdf[c].to_numpy()[at]
        return pd.DataFrame({"folder": col("folder", a), "file_a": col("file", a), "face_idx_a": col("face_idx", a), "file_b": col("file", b), "face_idx_b": col("face_idx", b), "sim": sim[a, b]})

    rows = dealt.select("folder", "file", "face_idx", "embed", "g", "block", "cross")
    return rows.groupBy("g").applyInPandas(compare, schema).withColumnRenamed("folder", within)


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a spanning forest of links (a matrix whose upper triangle counts): a search by breadth, a row at a time."""
    links, left = hit | hit.T, np.ones(len(hit), bool)
    a, b = [], []
    for start in range(len(hit)):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            i = queue.pop()
            found = np.flatnonzero(links[i] & left)
            left[found] = False
            a += [i] * len(found)
            b += found.tolist()
            queue += found.tolist()
    return np.array(a, int), np.array(b, int)


def average_linkage(vectors: np.ndarray, threshold: float) -> list[list[int]]:
    """Clusters by average linkage: the two with the greatest mean similarity merge as long as that is over the threshold.
    Largest clusters first, then by their first member.

    A mean similarity of two clusters is the product of their mean vectors, so a vector a cluster is all that is held: n
    times its length, and each step is one product with all of them. Steps follow the chain of nearest neighbours: two
    that are each other's nearest merge, which for average linkage gives the same clusters as the greatest pair first
    (equal similarities aside: the earlier cluster is preferred). A cluster whose nearest is not over the threshold stays
    as it is, since merging others never brings them nearer to it than the nearer of them was.
    """
    n = len(vectors)
    if not n:
        return []
    mean, size = np.array(vectors, np.float64), np.ones(n)
    live, members = np.ones(n, bool), [[i] for i in range(n)]
    done: list[list[int]] = []
    chain: list[int] = []
    while chain or live.any():
        a = chain[-1] if chain else int(live.argmax())
        chain = chain or [a]
        near = np.where(live, mean @ mean[a], -np.inf)
        near[a] = -np.inf
        b = int(near.argmax())
        if len(chain) > 1 and near[chain[-2]] == near[b]:
            b = chain[-2]
        if not near[b] > threshold:
            live[a] = False
            done.append(sorted(members[a]))
            chain.pop()
        elif len(chain) > 1 and b == chain[-2]:
            i, j = min(a, b), max(a, b)
            mean[i] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
            size[i] += size[j]
            members[i] += members[j]
            live[j] = False
            del chain[-2:]
        else:
            chain.append(b)
    return sorted(done, key=lambda m: (-len(m), m[0]))


def cluster(core: DataFrame, threshold: float) -> DataFrame:
    """Average-linkage clusters of each folder's core faces (in capture order: `ord`, file, face): FACE_KEY and cluster, from 0.

    Clusters can only merge over a pair that is over the threshold itself. So a folder falls apart exactly into the
    components of such pairs, and each component, not each folder, is clustered in one task, which holds one vector a face
    and takes time by the square of their number; faces without any such pair are clusters of their own. Only spanning
    forests of the pairs are made.
    """
    node = lambda s="": F.xxhash64("folder", *(F.col(c + s) for c in ("file", "face_idx")))
    faces, _ = cut(core.select(*FACE_KEY, "ord", F.col("embed").cast("array<double>").alias("embed"), node().alias("node")), "faces")
    linked = similar_pairs(faces, threshold, forest=True).select(node("_a").alias("a"), node("_b").alias("b"))
    parts = faces.join(components(linked), "node", "left")
    schema = T.StructType([*(core.schema[k] for k in FACE_KEY), core.schema["ord"], T.StructField("part", T.LongType()), T.StructField("local", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "file", "face_idx"], kind="stable").reset_index(drop=True)
        label = np.zeros(len(pdf), np.int32)
        for k, m in enumerate(average_linkage(np.stack(pdf["embed"].to_numpy()), threshold)):
            label[m] = k
        return pdf[[*FACE_KEY, "ord"]].assign(part=pdf["component"], local=label)

    many = parts.where("component is not null").groupBy("component").applyInPandas(run, schema)
    alone = parts.where("component is null").select(*FACE_KEY, "ord", F.col("node").alias("part"), F.lit(-1).alias("local"))
    labels = many.unionByName(alone)
    first = F.min(F.struct("ord", "file", "face_idx"))
    sizes = labels.groupBy("folder", "part", "local").agg(F.count("*").alias("size"), first.alias("first"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("size"), "first")) - 1
    return labels.join(sizes.withColumn("cluster", place).select("folder", "part", "local", "cluster"), ["folder", "part", "local"]).select(*FACE_KEY, "cluster")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, scope: list[str], block: int = BLOCK) -> DataFrame:
    """For each row of left (keys, v) the row of right (place, v) of its scope with the greatest inner product over the
    threshold, the largest place among equals: keys, place. Rows without any are left out.

    Both sides fall into blocks, by their numbers in a scope; pairs of blocks are multiplied as matrices, so a task holds two
    blocks whatever the sizes, and only each row's best leaves it.
    """
    own = scope or ["_all"]
    if not scope:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
    blocks_of = lambda d, name: d.groupBy(*own).agg(F.ceil(F.count("*") / block).alias(name))
    many = blocks_of(left, "_nl").join(blocks_of(right, "_nr"), own)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(many, own).select(*{*own, *keys}, "v", F.pmod(F.xxhash64(*keys), "_nl").alias("_l"), every("_nr").alias("_r"))
    b = right.join(many, own).select(*(F.col(c).alias(f"_of_{c}") for c in own), F.col("place").alias("_place"), F.col("v").alias("w"), F.pmod(F.xxhash64("place"), "_nr").alias("_rr"), every("_nl").alias("_ll"))
    schema = T.StructType([*(a.schema[k] for k in keys), T.StructField("near", T.DoubleType()), T.StructField("place", b.schema["_place"].dataType)])

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=[f.name for f in schema])
        y = y.sort_values("_place", ascending=False, kind="stable")
        near = np.stack(x["v"].to_numpy()).astype(float) @ np.stack(y["w"].to_numpy()).astype(float).T
        top = near.argmax(1)
        out = x[keys].assign(near=near.max(1), place=y["_place"].to_numpy()[top])
        return out[out["near"] > threshold]

    found = a.groupBy(*own, "_l", "_r").cogroup(b.groupBy(*(f"_of_{c}" for c in own), "_ll", "_rr")).applyInPandas(best, schema)
    return found.groupBy(*keys).agg(F.max(F.struct("near", "place")).alias("b")).select(*keys, F.col("b.place").alias("place"))


def recognise(vectors: DataFrame, library: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Adds to vectors (keys, centroid) the named person whose samples are most similar on average, over the threshold
    (the last of the library among equals), or null: person_id, name.

    A mean of products with samples is the product with their mean, so a person is one vector.
    """
    some = library.where(F.size("samples") > 0)
    means = some.select(F.col("pos").cast("long").alias("place"), F.transform(F.sequence(F.lit(0), F.size(F.col("samples")[0]) - 1), lambda i: F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.get(x, i)) / F.size("samples")).alias("v"))
    best = nearest(vectors.select(*keys, F.col("centroid").alias("v")), means, keys, threshold, [])
    who = best.join(library.select(F.col("pos").cast("long").alias("place"), F.col("id").alias("person_id"), "name"), "place").drop("place")
    return vectors.join(who, keys, "left")


def attach(weak: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Weak faces with the person of their folder whose centroid is most similar, over the threshold (the largest id among
    equals): FACE_KEY, person_id."""
    d = nearest(weak.select(*FACE_KEY, F.col("embed").alias("v")), known.select("folder", F.col("person_id").alias("place"), F.col("centroid").alias("v")), FACE_KEY, threshold, ["folder"])
    return d.withColumnRenamed("place", "person_id")


def apply_overrides(members: DataFrame, overrides: DataFrame, faces: DataFrame) -> DataFrame:
    """A user's fixes (folder, key "file:face", person_id; 0 is nobody) on members (FACE_KEY, person_id).

    Named faces leave their person; those that exist join the one they are given. The last colon parts file and face.
    """
    idx = F.regexp_extract("key", r"^(.*):(\d+)$", 2)
    fixes = overrides.where(F.col("key").rlike(r"^.*:\d+$")).select("folder", F.regexp_extract("key", r"^(.*):(\d+)$", 1).alias("file"), idx.cast("int").alias("face_idx"), "person_id")
    kept = members.join(fixes, FACE_KEY, "left_anti").select(*FACE_KEY, "person_id")
    return kept.unionByName(fixes.where("person_id <> 0").join(faces.select(*FACE_KEY), FACE_KEY, "left_semi").select(*FACE_KEY, "person_id"))


def people(faces: DataFrame, library: DataFrame, overrides: DataFrame, cfg: PeopleConfig = PeopleConfig()) -> DataFrame:
    """Persons of each folder with their faces: folder, person_id, name, n_faces, faces, place.

    faces: FACE_KEY, ord (time, or any number that gives the capture order with the file), embed, embed_norm, presence. Core faces are clustered; a cluster gets a library
    person's id, or unnamed_base plus its rank among the unnamed of two faces or more. Of two clusters recognised as one
    person the later gives the centroid to which weak faces are attached. Named people come first, then by faces.
    """
    parts = split_faces(faces, cfg)
    core = parts.where("part = 'core'")
    labels = cluster(core, cfg.same)
    sums = centroids(core.join(labels, FACE_KEY), ["folder", "cluster"])
    known = recognise(sums, library, cfg.same, ["folder", "cluster"]).where("person_id is not null or n >= 2")
    rank = F.sum(F.col("person_id").isNull().cast("long")).over(Window.partitionBy("folder").orderBy("cluster"))
    ids = known.withColumn("person_id", F.coalesce("person_id", rank + cfg.unnamed_base))
    clear = labels.join(ids.select("folder", "cluster", "person_id"), ["folder", "cluster"]).select(*FACE_KEY, "person_id")
    last = ids.groupBy("folder", "person_id").agg(F.max_by("centroid", "cluster").alias("centroid"))
    members = clear.unionByName(attach(parts.where("part = 'weak'"), last, cfg.attach))
    fixed = apply_overrides(members, overrides, faces)
    named = fixed.join(library.select(F.col("id").alias("person_id"), "name"), "person_id", "left")
    rows = named.join(faces.select(*FACE_KEY, "ord"), FACE_KEY).groupBy("folder", "person_id", "name").agg(F.count("*").alias("n_faces"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "file", "face_idx"))), lambda s: F.concat_ws(":", s["file"], s["face_idx"])).alias("faces"))
    order = Window.partitionBy("folder").orderBy(F.col("name").isNull(), F.desc("n_faces"), "person_id")
    return rows.withColumn("place", F.row_number().over(order))


def cards(members: DataFrame) -> DataFrame:
    """For each person of a folder: distinct photos, faces and the clearest face (greatest norm, the last in order among
    equals). members: FACE_KEY, ord, person_id, embed_norm."""
    best = F.max(F.struct("embed_norm", "ord", "file", "face_idx"))
    return members.groupBy("folder", "person_id").agg(F.count_distinct("file").alias("photos"), F.count("*").alias("n_faces"), best.alias("b")).select("folder", "person_id", "photos", "n_faces", F.col("b.file").alias("best_file"), F.col("b.face_idx").alias("best_face"))


def numbered(persons: DataFrame) -> DataFrame:
    """Adds the name shown: a person's own, or `Person N` in their order among the unnamed of the folder."""
    n = F.sum(F.col("name").isNull().cast("int")).over(Window.partitionBy("folder").orderBy("place"))
    return persons.withColumn("shown", F.coalesce("name", F.concat(F.lit("Person "), n.cast("string"))))


def spread(n: Column, cap: int) -> Column:
    """Places of an even sample of at most about `cap` of n items, from 0."""
    step = F.greatest(n / F.lit(float(cap)), F.lit(1.0))
    tried = F.transform(F.sequence(F.lit(0), F.lit(cap)), lambda k: F.floor(k * step).cast("int"))
    return F.array_distinct(F.filter(tried, lambda p: p < n))


def learn(library: DataFrame, learned: DataFrame, cfg: PeopleConfig = PeopleConfig()) -> DataFrame:
    """Adds learned vectors (name, embeds) to a library (id, name, samples): matched to a person by trimmed name in ASCII
    case, else a new person with the next free id, new names in their order. Samples are spread over a set, and only
    the last `samples` of a person are kept."""
    key = lambda c: F.translate(F.trim(c), UPPER, LOWER)
    new = learned.select(key(F.col("name")).alias("k"), F.trim("name").alias("new_name"), F.col("embeds"))
    new = new.select("k", "new_name", F.transform(spread(F.size("embeds"), cfg.samples), lambda p: F.get("embeds", p)).alias("more"))
    d = library.select(key(F.col("name")).alias("k"), "id", "name", "samples").join(new, "k", "full_outer")
    top = library.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("k"))
    all_samples = F.concat(F.coalesce("samples", F.array().cast(library.schema["samples"].dataType)), F.coalesce("more", F.array().cast(library.schema["samples"].dataType)))
    kept = F.slice(all_samples, F.greatest(F.size(all_samples) - cfg.samples + 1, F.lit(1)), cfg.samples)
    return d.join(F.broadcast(top)).select(F.coalesce("id", F.col("top") + fresh).cast("long").alias("id"), F.coalesce("name", "new_name").alias("name"), kept.alias("samples"))


def rename(library: DataFrame, person: int, name: str, cfg: PeopleConfig = PeopleConfig()) -> DataFrame:
    """Renames a person. An empty name forgets them; another person's name (in ASCII case) merges them into that one,
    whose samples come first and of which the last are kept."""
    name = name.strip()
    if not name:
        return library.where(F.col("id") != person)
    one, other = library.where(F.col("id") == person), F.translate("name", UPPER, LOWER) == name.translate(str.maketrans(UPPER, LOWER))
    moved = one.select(F.lit(name).alias("name"), F.col("samples").alias("embeds"))
    taken = library.where((F.col("id") != person) & other)
    merged = learn(taken, moved.join(taken.select(F.lit(1).alias("one")).limit(1), how="left_semi"), cfg)
    rest = library.where((F.col("id") != person) & ~other)
    alone = one.join(taken.select(F.lit(1).alias("one")), how="left_anti").withColumn("name", F.lit(name))
    return rest.select("id", "name", "samples").unionByName(merged.select("id", "name", "samples")).unionByName(alone.select("id", "name", "samples"))
