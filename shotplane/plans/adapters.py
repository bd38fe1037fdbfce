"""The driver's tables as inputs of the operators.

One text for both engines; what they spell differently stands as @us( (microseconds of a timestamp) and @arr( (an array).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Formulas of the two faces of a frame, by k = 0, 1.
FACE = {
    "presence": "((event_id * 17 + {k} * 31) % 100 + 40) / 1.4e2",
    "eye_px0": "cast((event_id * 7 + {k} * 3) % 120 as double)",
    "eye_px1": "cast((event_id * 11 + {k} * 5) % 120 as double)",
    "eye_sharp0": "value * ((event_id + {k}) % 7 + 1) / 1e1",
    "eye_sharp1": "value * ((event_id * 3 + {k}) % 9) / 1e1",
    "blink0": "((event_id * 13 + {k} * 7) % 100) / 1e2",
    "blink1": "((event_id * 29 + {k} * 11) % 100) / 1e2",
    "smile": "((event_id * 19 + {k} * 23) % 100) / 1e2",
    "cut": "(event_id * 3 + {k}) % 11 = 0",
    "bx": "cast((event_id * 31 + {k} * 997) % 3000 as double)",
    "by": "cast((event_id * 17 + {k} * 501) % 3000 as double)",
    "bw": "cast(200 + (event_id * 5 + {k} * 90) % 400 as double)",
    "bh": "cast(250 + event_id % 300 as double)",
    "luma": "cast((event_id * 41 + {k}) % 256 as double)",
}


def face_select(k: int) -> str:
    return ", ".join(f"{f.format(k=k)} as {n}" for n, f in FACE.items())


SQL = {
    "frames": "select user_id as folder, cast(event_id as string) as file, event_id, value, event_type, @us(ts) / 1e6 as time, case when event_id % 97 = 0 then 0 when event_type <> 'error' then 6000 else 4000 end as width, case when event_id % 97 = 0 then 0 when event_type <> 'error' then 4000 else 6000 end as height, value as frame_sharp, event_id % 97 = 0 as failed, event_id % 5 = 0 or event_id % 97 = 0 as faceless, (user_id * 37 + event_id % 7) % 256 as s0, (user_id * 59 + event_id % 11) % 256 as s1, (user_id * 11 + event_id % 13) % 256 as s2, (user_id * 7 + event_id % 5) % 256 as s3 from events",
    "decisions": "select cast(user_id as bigint) as folder, cast(event_id as string) as file, case when event_id % 3 = 0 then 'reject' when event_id % 3 = 1 then 'pick' else 'none' end as mark from events where event_id % 4 <> 0",
    "faces": "select label as folder, cast(vec_id / 2 - (vec_id % 2) / 2e0 as bigint) as file, cast(vec_id % 2 as int) as face_idx, vec_id, embedding as embed, 4 + (vec_id * 37 % 100) / 1e1 as embed_norm, (vec_id * 53 % 100) / 1e2 as presence from embeddings",
    "library": "select vec_id as id, 'P' || cast(vec_id as string) as name, embedding as sample from embeddings where vec_id % 100 = 3",
    "marks": "select d.doc_id, d.source as folder, cast(d.doc_id as string) as file, case when l.toxic = 1 then 'reject' when l.quality = 1 then 'pick' else 'none' end as decided, case when d.n_chars < 400 then 'reject' when d.n_chars < 3000 then 'pick' else 'none' end as predicted, d.n_chars from documents d join labels l on d.doc_id = l.doc_id",
    "boxes": "select l_orderkey as image, cast(l_linenumber as bigint) as id, cast(l_partkey * 13 % 800 as double) as x, cast(l_suppkey * 29 % 600 as double) as y, 40e0 + l_partkey % 260 as w, 50e0 + l_suppkey % 240 as h, (l_partkey * 7 % 1000) / 1e3 as score from lineitem",
    "targets": "select o_custkey % 50 as folder, cast(o_orderkey as string) as file, case when o_orderstatus = 'F' then -1 end as rating, o_orderstatus = 'O' as green, o_orderstatus, o_orderkey from orders where o_orderstatus <> 'P'",
    "sent": "select o_custkey % 50 as folder, cast(o_orderkey as string) as file, case when o_orderkey % 3 = 0 then -1 when o_orderkey % 3 = 1 then 2 end as rating_set, case when o_orderkey % 3 <> 2 then cast(o_orderkey % 5 as int) end as rating_before, case when o_orderkey % 4 < 2 then o_orderkey % 4 = 1 end as green_before, o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')",
    "files": "select o_custkey % 40 as folder, 'IMG-' || cast(cast(floor(o_orderkey / 3e0) as bigint) as string) || case when o_orderkey % 3 = 0 then '.CR3' when o_orderkey % 3 = 1 then '.jpg' else '.txt' end as file, 1000 + o_orderkey % 777 as size, 1700000000 + o_orderkey as mtime, o_orderkey from orders",
    "scenes": "select s_suppkey as scene, cast(4000 + s_suppkey % 5 * 800 as int) as width, cast(3000 + s_suppkey % 7 * 500 as int) as height, s_suppkey % 3 - 1 as side, (s_suppkey * 17 % 40) / 1e2 as px, (s_suppkey * 31 % 30) / 1e2 as py from supplier",
    "cells": "select l_suppkey % 20 as image, cast(floor(l_orderkey / 7e0) as bigint) % 12 as r, l_orderkey % 15 as c, avg(l_quantity) as q, avg(l_discount) as d, count(*) as n from lineitem group by 1, 2, 3",
}


def duck(name: str) -> str:
    return SQL[name].replace("@us(", "epoch_us(").replace("@arr(", "list_value(")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter over the tables of a folder."""
    text = re.sub(r"@us\((\w+)\)", r"unix_micros(cast(\1 as timestamp))", SQL[name]).replace("@arr(", "array(")
    used = [t for t in TABLES if re.search(rf"(from|join) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def face(k: int):
    """A frame's face k as a struct."""
    e = {n: F.expr(f.format(k=k)) for n, f in FACE.items()}
    pair = lambda n: F.array(e[f"{n}0"], e[f"{n}1"])
    return F.struct(F.array(e["bx"], e["by"], e["bw"], e["bh"]).alias("bbox"), e["presence"].alias("presence"), pair("eye_px").alias("eye_px"), pair("eye_sharp").alias("eye_sharp"), pair("blink").alias("blink"), e["smile"].alias("smile"), e["cut"].alias("cut"), e["luma"].alias("face_luma"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with nested faces and a signature. Failed frames have neither, and no size."""
    d = table(spark, sf_dir, "frames")
    faces = F.array(face(0), face(1))
    none = F.slice(faces, 1, 0)
    sig = F.array(*(F.col(f"s{k}").cast("smallint") for k in range(4)))
    return d.select("folder", "file", "event_id", "value", "event_type", "time", "width", "height", F.when(F.col("failed"), 0.0).otherwise(F.col("frame_sharp")).alias("frame_sharp"), F.when(F.col("faceless"), none).otherwise(faces).alias("faces"), F.when(F.col("failed"), F.slice(sig, 1, 0)).otherwise(sig).alias("sig"), F.when(F.col("failed"), F.lit("unreadable")).alias("error"))
