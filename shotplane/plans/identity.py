"""Queries on faces as people, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane.config import PeopleConfig
from shotplane.functions.vectors import centroids, dot, normalized
from shotplane.operators import people
from shotplane.plans import adapters
from shotplane.plans.adapters import duck

#: The test vectors are spread evenly, so a lower threshold gives clusters worth looking at.
CFG = PeopleConfig(same=0.3, attach=0.15)
KEYS = people.FACE_KEY


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "faces").withColumn("ord", F.col("file")).withColumn("file", F.col("file").cast("string"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "library")
    return d.select("id", "name", F.array(F.col("sample").cast("array<double>")).alias("samples"), F.col("id").alias("pos"))


def core_weak_split(spark, sf_dir):
    return people.split_faces(faces(spark, sf_dir)).select(*KEYS, "part")


def cosine_pairs(spark, sf_dir):
    return people.similar_pairs(faces(spark, sf_dir), 0.3).withColumn("sim", F.round("sim", 4))


def vector_mean(spark, sf_dir):
    d = centroids(faces(spark, sf_dir), ["folder"])
    return d.select("folder", "n", *(F.round(F.get("centroid", F.lit(k)), 4).alias(f"c{k}") for k in (0, 31, 63)), F.round(dot(normalized(F.col("centroid")), F.col("centroid")), 4).alias("unit"))


def recognise_people(spark, sf_dir):
    d = faces(spark, sf_dir).select(*KEYS, F.col("embed").cast("array<double>").alias("centroid"))
    return people.recognise(d, library(spark, sf_dir), 0.3, KEYS).select(*KEYS, "person_id", "name")


def attach_weak(spark, sf_dir):
    d = faces(spark, sf_dir)
    known = d.where("vec_id % 50 < 10").select("folder", F.col("vec_id").alias("person_id"), F.col("embed").alias("centroid"))
    return people.attach(d.where("vec_id % 50 >= 10"), known, 0.25)


def person_overrides(spark, sf_dir):
    d = faces(spark, sf_dir)
    members = d.where("vec_id % 3 <> 0").select(*KEYS, (F.col("vec_id") % 5 + 1).alias("person_id"))
    keys = d.where("vec_id % 7 = 0").select("folder", F.concat_ws(":", "file", "face_idx").alias("key"), (F.col("vec_id") % 4).alias("person_id"))
    lost = d.where("vec_id % 11 = 0").select("folder", F.concat_ws(":", "file", F.lit("9")).alias("key"), F.lit(2).cast("long").alias("person_id"))
    return people.apply_overrides(members, keys.unionByName(lost), d)


def person_cards(spark, sf_dir):
    d = faces(spark, sf_dir).withColumn("person_id", F.col("vec_id") % 6)
    return people.cards(d)


def person_sheet(spark, sf_dir):
    d = faces(spark, sf_dir).withColumn("person_id", F.col("vec_id") % 2)
    return people.sheet(d).select("folder", "person_id", "file", "face_idx", "column")


def identity_faces(spark, sf_dir):
    return people.wide_enough(adapters.table(spark, sf_dir, "boxes")).groupBy("image").agg(F.count("*").alias("n"))


def numbered_people(spark, sf_dir):
    d = faces(spark, sf_dir).withColumn("person_id", F.col("vec_id") % 6).groupBy("folder", "person_id").agg(F.count("*").alias("place"))
    d = d.withColumn("place", F.col("person_id") + 1).withColumn("name", F.when(F.col("person_id") % 3 == 0, F.concat(F.lit("N"), F.col("person_id").cast("string"))))
    return people.numbered(d).select("folder", "person_id", "shown")


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of each label as embeds of a name: P3 is known, others are new."""
    d = adapters.load(spark, sf_dir, "embeddings").where("label is not null")
    e = d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))), lambda s: s["v"]).alias("embeds"))
    return e.select(F.concat(F.lit(" p"), F.col("label").cast("string")).alias("name"), "embeds")


def library_learn_cap(spark, sf_dir):
    d = people.learn(library(spark, sf_dir), learned(spark, sf_dir))
    return d.select("id", "name", F.size("samples").alias("n"), F.round(F.get(F.element_at("samples", 1), F.lit(0)), 5).alias("first"), F.round(F.get(F.element_at("samples", -1), F.lit(0)), 5).alias("last"))


def library_rename_merge(spark, sf_dir):
    lib = library(spark, sf_dir).drop("pos")
    merged = people.rename(people.rename(people.rename(lib, 103, "p3"), 203, "Ann"), 303, " ")
    return merged.select("id", "name", F.size("samples").alias("n"))


def cluster_people(spark, sf_dir):
    f, lib = faces(spark, sf_dir), library(spark, sf_dir)
    fixes = f.where("vec_id % 40 = 0").select("folder", F.concat_ws(":", "file", "face_idx").alias("key"), (F.col("vec_id") % 3).alias("person_id"))
    return people.people(f, lib, fixes, CFG)


F_ = f"f as ({duck('faces')})"
DOT = "list_dot_product(cast({a} as double[]), cast({b} as double[]))"
COORDS = ", ".join(f"round(max(case when pos = {k} then x / n end), 4) as c{k}" for k in (0, 31, 63))

ENTRIES = {
    "core_weak_split": (core_weak_split, f"with {F_} select folder, cast(file as string) as file, face_idx, case when embed_norm >= 9.5e0 and presence >= 0.5e0 then 'core' else 'weak' end as part from f where embed_norm >= 5.5e0"),
    "cosine_pairs": (cosine_pairs, f"with {F_} select a.folder, cast(a.file as string) as file_a, a.face_idx as face_idx_a, cast(b.file as string) as file_b, b.face_idx as face_idx_b, round({DOT.format(a='a.embed', b='b.embed')}, 4) as sim from f a join f b on a.folder = b.folder and (cast(a.file as string) < cast(b.file as string) or (a.file = b.file and a.face_idx < b.face_idx)) where {DOT.format(a='a.embed', b='b.embed')} > 0.3e0"),
    "vector_mean": (vector_mean, f"with {F_}, x as (select folder, vec_id, unnest(cast(embed as double[])) as x, unnest(range(0, 64)) as pos from f), s as (select folder, pos, sum(x) as x, count(*) as k from x group by 1, 2), n as (select folder, sqrt(sum(x * x)) as n, max(k) as k from s group by 1) select s.folder, max(n.k) as n, {COORDS}, round(sum(x / n * x / n), 4) as unit from s join n on s.folder = n.folder group by s.folder"),
    "recognise_people": (recognise_people, f"with {F_}, l as ({duck('library')}), s as (select f.vec_id, l.id, l.name, row_number() over (partition by f.vec_id order by {DOT.format(a='f.embed', b='l.sample')} desc, l.id desc) as k from f join l on {DOT.format(a='f.embed', b='l.sample')} > 0.3e0) select f.folder, cast(f.file as string) as file, f.face_idx, s.id as person_id, s.name from f left join s on f.vec_id = s.vec_id and s.k = 1"),
    "attach_weak": (attach_weak, f"with {F_}, s as (select w.folder, w.file, w.face_idx, k.vec_id as person_id, row_number() over (partition by w.vec_id order by {DOT.format(a='w.embed', b='k.embed')} desc, k.vec_id desc) as r from f w join f k on w.folder = k.folder and w.vec_id % 50 >= 10 and k.vec_id % 50 < 10 where {DOT.format(a='w.embed', b='k.embed')} > 0.25e0) select folder, cast(file as string) as file, face_idx, person_id from s where r = 1"),
    "person_overrides": (person_overrides, f"with {F_} select folder, cast(file as string) as file, face_idx, case when vec_id % 7 = 0 then vec_id % 4 else vec_id % 5 + 1 end as person_id from f where (vec_id % 7 = 0 and vec_id % 4 <> 0) or (vec_id % 7 <> 0 and vec_id % 3 <> 0)"),
    "person_cards": (person_cards, f"with {F_}, b as (select *, row_number() over (partition by folder, vec_id % 6 order by embed_norm desc, file desc, face_idx desc) as k from f) select folder, vec_id % 6 as person_id, count(distinct file) as photos, count(*) as n_faces, max(case when k = 1 then cast(file as string) end) as best_file, max(case when k = 1 then face_idx end) as best_face from b group by 1, 2"),
    "person_sheet": (person_sheet, f"with {F_} select folder, vec_id % 2 as person_id, cast(file as string) as file, face_idx, k as column from (select *, row_number() over (partition by folder, vec_id % 2 order by file, face_idx) as k from f) where k <= 16"),
    "identity_faces": (identity_faces, f"with b as ({duck('boxes')}) select image, count(*) as n from b where w >= 48 group by 1"),
    "numbered_people": (numbered_people, f"with {F_}, p as (select distinct folder, vec_id % 6 as person_id from f) select folder, person_id, case when person_id % 3 = 0 then 'N' || cast(person_id as string) else 'Person ' || cast(cast(sum(case when person_id % 3 <> 0 then 1 else 0 end) over (partition by folder order by person_id rows unbounded preceding) as bigint) as string) end as shown from p"),
    "library_learn_cap": (
        library_learn_cap,
        f"""with l as ({duck('library')}), e as (select label, embedding, row_number() over (partition by label order by vec_id) - 1 as i, count(*) over (partition by label) as n from embeddings where label is not null),
    k as (select label, e.embedding, row_number() over (partition by label order by i) as r from e where exists (select 1 from (select unnest(range(0, 25)) as t) s where cast(floor(s.t * greatest(n / 24e0, 1e0)) as bigint) = i)),
    t as (select label, max(r) as n from k group by 1), top as (select max(id) as top from l),
    fresh as (select label, row_number() over (order by 'p' || cast(label as string)) as f from t where not exists (select 1 from l where lower(l.name) = 'p' || cast(t.label as string))),
    a as (select l.id, l.name, 0 as r, l.sample as v from l union all select coalesce(l.id, top.top + fresh.f), coalesce(l.name, 'p' || cast(k.label as string)), k.r, k.embedding from k cross join top left join l on lower(l.name) = 'p' || cast(k.label as string) left join fresh on fresh.label = k.label),
    b as (select *, row_number() over (partition by id order by r desc) as back from a), c as (select *, row_number() over (partition by id order by r) as fwd, count(*) over (partition by id) as n from b where back <= 24)
    select id, name, max(n) as n, round(max(case when fwd = 1 then cast(v[1] as double) end), 5) as first, round(max(case when back = 1 then cast(v[1] as double) end), 5) as last from c group by 1, 2""",
    ),
    "library_rename_merge": (library_rename_merge, f"with l as ({duck('library')}) select id, case when id = 203 then 'Ann' else name end as name, case when id = 3 then 2 else 1 end as n from l where id not in (103, 303)"),
    "cluster_people": (cluster_people, None),
}
