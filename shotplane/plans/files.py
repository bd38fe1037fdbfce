"""Queries on listings, caches, names and times, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane.functions import exif, hashing, text, vectors
from shotplane.plans import adapters
from shotplane.plans.adapters import duck
from shotplane.sources import listing, state

KEYS = ("folder", "file")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "files").select(F.col("folder").cast("string").alias("folder"), "file", "size", "mtime", "o_orderkey").dropDuplicates(["folder", "file"])


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return files(spark, sf_dir).where("o_orderkey % 5 <> 0").select("folder", "file", F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k % 11 == 0, F.col("mtime") - 5).otherwise(F.col("mtime")).alias("mtime"), F.when(k % 13 == 0, 0).otherwise(1).alias("version"), F.when(k % 17 == 0, F.lit("unreadable")).alias("error"))


def scan_photos_dedup(spark, sf_dir):
    return listing.photos(files(spark, sf_dir)).select(*KEYS)


def cache_hits(spark, sf_dir):
    return listing.cache_hits(cached(spark, sf_dir), files(spark, sf_dir)).select(*KEYS)


def cache_misses(spark, sf_dir):
    return listing.cache_misses(cached(spark, sf_dir), files(spark, sf_dir)).select(*KEYS)


def cache_merge(spark, sf_dir):
    old, now = cached(spark, sf_dir), files(spark, sf_dir)
    hits = listing.cache_hits(old, now).select(*KEYS, F.lit(True).alias("held"))
    return listing.merge(hits, listing.cache_misses(old, now).select(*KEYS, F.lit(False).alias("held"))).groupBy("folder").agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("anew"))


def exif_time(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    odd = F.when(k % 9 == 0, F.lit("2026:02:31 25:61:07")).when(k % 9 == 1, F.lit("no date")).when(k % 9 == 2, F.lit("2024:01:02 03:04")).otherwise(stamp)
    return d.select("o_orderkey", exif.parse_exif_time(odd).alias("t"), F.round(exif.sub_second(F.when(k % 4 == 0, "x7").when(k % 4 == 1, F.lit(None)).otherwise((k % 1000).cast("string"))), 6).alias("sub"))


def scan_ordered(spark, sf_dir):
    """Photos with metadata from exported rows; place is the order of capture in a folder."""
    d = files(spark, sf_dir)
    rows = d.where("o_orderkey % 6 <> 0").select(F.concat_ws("/", "folder", "file").alias("SourceFile"), F.when(F.col("o_orderkey") % 8 == 1, 6).alias("Orientation"), F.lit("2024:05:06 07:08:09").alias("DateTimeOriginal"), (F.col("o_orderkey") % 10).cast("string").alias("SubSecTimeOriginal"))
    return listing.scan(d, listing.exif_rows(rows)).select(*KEYS, F.round("time", 3).alias("time"), "orientation")


def file_names(spark, sf_dir):
    d = files(spark, sf_dir)
    n = text.image_names(F.col("file"), F.lit(1))
    path = F.concat_ws("/", F.lit("/a.b/c"), "folder", "file")
    return d.select(*KEYS, text.stem(F.col("file")).alias("stem"), text.extension(F.col("file")).alias("ext"), text.short_name(F.col("file")).alias("short"), text.file_name(path).alias("name"), n["thumb"].alias("thumb"), n["eyes"].alias("eyes"), text.queue_name(path, "todo").alias("queue"))


def fnv_low32(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "pages")
    return d.select("page_id", hashing.fnv1a_low32(F.col("url")).alias("h"))


def crop_ids(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "supplier")
    f = lambda k: (F.col("s_suppkey") * k % 97 / 97.0)
    return d.select("s_suppkey", hashing.crop_id(f(3), f(5), f(7), f(11)).alias("id"))


def session_state(spark, sf_dir):
    """Sessions saved as text and read again: old, broken and full ones."""
    d = adapters.load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("folder"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("{broken")).when(F.col("n_nationkey") % 3 == 1, F.lit('{"decisions":{"a":{"mark":"pick","stars":3}},"later":1}')).otherwise(F.lit('{"decisions":{"b":{"mark":"reject"}},"splits":["x","y"],"people":{"a:0":7}}')).alias("text"))
    s = state.parse_sessions(d)
    return s.select("folder", F.size("decisions").alias("n"), F.array_join(F.map_keys("decisions"), ",").alias("files"), F.size("splits").alias("splits"), F.size("joins").alias("joins"), F.get(F.map_values("people"), F.lit(0)).alias("person"))


def signature_stretch(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "embeddings")
    g = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 127.5).cast("int"))
    return d.select("vec_id", F.array_join(vectors.stretch(g), ",").alias("sig"))


def named_score(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "embeddings")
    names = ["blink", "smile"]
    v = F.col("embedding").cast("array<double>")
    return d.select("vec_id", *(F.round(vectors.named(v, names, n), 6).alias(n) for n in ("blink", "smile", "frown")))


FILES = f"f0 as (select cast(folder as string) as folder, file, size, mtime, o_orderkey, row_number() over (partition by folder, file order by o_orderkey) as k from ({duck('files')})), f as (select * from f0 where k = 1), e as (select *, regexp_replace(file, '\\.[^.]*$', '') as stem, lower(regexp_extract(file, '\\.([^./]*)$', 1)) as ext from f)"
CACHED = "c as (select folder, file from f where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 17 <> 0)"
DAYS = "({y} * 365 + floor({y} / 4e0) - floor({y} / 1e2) + floor({y} / 4e2))"


def civil() -> str:
    """Days since 0000-03-01 in closed form: whole years, their leap days, and the days of the year from March."""
    yy = "(y - case when mo <= 2 then 1 else 0 end)"
    m = "(mo + case when mo <= 2 then 9 else -3 end)"
    return f"({DAYS.format(y=yy)} + floor(({m} * 153 + 2) / 5e0) + d - 1)"


#: Bits of single-precision numbers from 0 to 1 by their exponent and fraction, then one step of the hash a byte.
FLOATS = "select s_suppkey, unnest(range(0, 4)) as i, unnest([3, 5, 7, 11]) as m from supplier"
CROP_IDS = f"""with recursive v as (select s_suppkey, i, cast(cast(s_suppkey * m % 97 / 97e0 as float) as double) as v from ({FLOATS})), e as (select *, case when v > 0 then floor(log2(v)) end as e from v),
t as (select s_suppkey, i, case when v = 0 then 0 else (cast(e as bigint) + 127) * 8388608 + cast((v / power(2, e) - 1) * 8388608 as bigint) end as bits from e),
y as (select s_suppkey, i * 4 + j + 1 as n, cast(floor(bits / power(256, j)) as bigint) % 256 as byte from t cross join (select unnest(range(0, 4)) as j)),
h as (select distinct s_suppkey, cast(0 as bigint) as n, cast(2216829733 as bigint) as h from y union all select h.s_suppkey, y.n, (xor(h.h, y.byte) * 435) % 4294967296 from h join y on h.s_suppkey = y.s_suppkey and y.n = h.n + 1)
select s_suppkey, lower(printf('%08x', h)) as id from h where n = 16"""

ENTRIES = {
    "scan_photos_dedup": (scan_photos_dedup, f"with {FILES} select folder, file from e where ext = 'cr3' or (ext = 'jpg' and not exists (select 1 from e r where r.folder = e.folder and r.stem = e.stem and r.ext = 'cr3'))"),
    "cache_hits": (cache_hits, f"with {FILES}, {CACHED} select folder, file from c"),
    "cache_misses": (cache_misses, f"with {FILES}, {CACHED} select f.folder, f.file from f left join c on f.folder = c.folder and f.file = c.file where c.file is null"),
    "cache_merge": (cache_merge, f"with {FILES}, {CACHED} select f.folder, count(c.file) as held, count(*) - count(c.file) as anew from f left join c on f.folder = c.folder and f.file = c.file group by 1"),
    "exif_time": (exif_time, f"with x as (select o_orderkey, case when o_orderkey % 9 = 0 then [2026, 2, 31, 25, 61, 7] when o_orderkey % 9 < 3 then null else [year(o_orderdate), month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), second(o_orderdate)] end as p from orders), q as (select *, p[1] as y, p[2] as mo, p[3] as d from x) select o_orderkey, cast({civil()} * 86400 + p[4] * 3600 + p[5] * 60 + p[6] as double) as t, round(case when o_orderkey % 4 < 2 then 0 else cast('0.' || cast(o_orderkey % 1000 as string) as double) end, 6) as sub from q"),
    "scan_ordered": (scan_ordered, f"with {FILES}, m as (select folder, file, (o_orderkey % 10) / 1e1 as s, case when o_orderkey % 8 = 1 then 6 else 1 end as o from f where o_orderkey % 6 <> 0), k as (select * from e where ext = 'cr3' or (ext = 'jpg' and not exists (select 1 from e r where r.folder = e.folder and r.stem = e.stem and r.ext = 'cr3'))) select k.folder, k.file, round(coalesce(m.s + (2024 * 365 + 506 - 20 + 5 + 66) * 86400e0 + 7 * 3600 + 8 * 60 + 9, 0), 3) as time, coalesce(m.o, 1) as orientation from k left join m on k.folder = m.folder and k.file = m.file"),
    "file_names": (file_names, f"with {FILES} select folder, file, stem, ext, split_part(stem, '-', 2) as short, file as name, stem || '_t.jpg' as thumb, stem || '_eyes1.jpg' as eyes, '%a.b%c%' || folder || '%' || file || '.todo' as queue from e"),
    "fnv_low32": (fnv_low32, "with recursive b as (select page_id, url, 1 as i, cast(2216829733 as bigint) as h from pages union all select page_id, url, i + 1, (xor(h, cast(ascii(substr(url, i, 1)) as bigint)) * 435) % 4294967296 from b where i <= length(url)) select page_id, h from b where i = length(url) + 1"),
    "crop_ids": (crop_ids, CROP_IDS),
    "session_state": (session_state, "select cast(n_nationkey as string) as folder, case when n_nationkey % 3 = 0 then 0 else 1 end as n, case n_nationkey % 3 when 0 then '' when 1 then 'a' else 'b' end as files, case when n_nationkey % 3 = 2 then 2 else 0 end as splits, 0 as joins, case when n_nationkey % 3 = 2 then 7 end as person from nation"),
    "signature_stretch": (signature_stretch, "with g as (select vec_id, list_transform(embedding, lambda x: cast(round((cast(x as double) + 1) * 127.5e0) as int)) as g from embeddings) select vec_id, array_to_string(list_transform(g, lambda v: cast(floor((v - list_min(g)) * 255 / cast(greatest(list_max(g) - list_min(g), 1) as double)) as int)), ',') as sig from g"),
    "named_score": (named_score, "select vec_id, round(cast(embedding[1] as double), 6) as blink, round(cast(embedding[2] as double), 6) as smile, 0.0 as frown from embeddings"),
}
