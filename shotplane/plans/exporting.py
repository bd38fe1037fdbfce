"""Queries on change feeds between decisions and an editor, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane.functions import text, xmp
from shotplane.operators import export
from shotplane.plans import adapters, culling
from shotplane.plans.adapters import duck
from shotplane.sources import editor

KEYS = ("folder", "file")


def tags(status: str) -> list[str]:
    return {"F": ["cull|reason|eyes-closed", "cull|reason|soft-eyes"], "O": ["cull|reason|sharpest", "cull|reason|smile"]}[status]


def array(items: list[str]):
    return F.array(*map(F.lit, items)).cast("array<string>")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "targets")
    return d.select(*KEYS, "rating", "green", F.when(F.col("o_orderstatus") == "F", array(tags("F"))).otherwise(array(tags("O"))).alias("tags"))


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "sent")
    t = F.when(F.col("o_orderkey") % 3 == 0, array(["cull|reason|eyes-closed"])).when(F.col("o_orderkey") % 3 == 1, array(["cull|reason|smile", "mine|x"])).otherwise(array([]))
    return d.select(*KEYS, "rating_set", "rating_before", "green_before", t.alias("tags"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.plan(target(spark, sf_dir), sent(spark, sf_dir))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The editor's images: most orders, some with a second version."""
    d = adapters.load(spark, sf_dir, "orders").where("o_orderkey % 10 <> 4")
    one = d.select((F.col("o_custkey") % 50).alias("folder"), F.col("o_orderkey").cast("string").alias("file"), (F.col("o_orderkey") % 6 - 1).cast("int").alias("rating"), (F.col("o_orderkey") % 2 == 0).alias("green"), F.lit(0).alias("duplicate"))
    return one.unionByName(one.where("file % 9 = 0").withColumn("duplicate", F.lit(1)).withColumn("rating", F.lit(5)))


def export_targets(spark, sf_dir):
    d = export.targets(culling.judged(spark, sf_dir))
    return d.select(*KEYS, "rating", "green", F.array_join("tags", ",").alias("tags"))


def export_plan(spark, sf_dir):
    return planned(spark, sf_dir).select(*KEYS, "rating", "green", F.array_join("add", ",").alias("add"), F.array_join("remove", ",").alias("remove"))


def export_record(spark, sf_dir):
    d = planned(spark, sf_dir).withColumns({"seq": F.lit(1), "before_rating": F.lit(3), "before_green": F.lit(False)})
    out = export.record(sent(spark, sf_dir), d)
    return out.select(*KEYS, "rating_set", "rating_before", "green_before", F.array_join("tags", ",").alias("tags"))


def change_lines(spark, sf_dir):
    d = planned(spark, sf_dir)
    return d.select(*KEYS, text.change_line(F.col("file"), F.col("rating"), F.col("green"), F.col("add"), F.col("remove")).alias("line"))


def change_parse(spark, sf_dir):
    d = change_lines(spark, sf_dir).select("folder", F.when(F.col("folder") % 7 == 0, F.replace("line", F.lit("keep"), F.lit("kept"))).otherwise(F.col("line")).alias("line"))
    p = text.parse_change(F.col("line"))
    return d.select("folder", p["file"].alias("file"), p["valid"].alias("valid"), p["rating"].alias("rating"), F.size(p["add"]).alias("n_add"), F.array_join(p["remove"], ",").alias("remove"))


def tag_levels(spark, sf_dir):
    d = sent(spark, sf_dir).join(planned(spark, sf_dir).select(*KEYS, "add", "remove"), list(KEYS))
    subject = F.array_sort(F.array_union(export.levels(F.col("tags")), F.array(F.lit("own"))))
    hier, subj = export.tag_levels(F.col("tags"), subject, F.col("add"), F.col("remove"))
    return d.select(*KEYS, F.array_join(hier, ",").alias("hierarchy"), F.array_join(subj, ",").alias("subject"))


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.apply_changes(images(spark, sf_dir), planned(spark, sf_dir))


def editor_apply(spark, sf_dir):
    return applied(spark, sf_dir).select(*KEYS, "status", "before_rating", "before_green", "rating_after", "green_after")


def receipts_merge(spark, sf_dir):
    lines = editor.receipt_lines(applied(spark, sf_dir)).select("folder", F.lit(1).alias("seq"), "line")
    ok = editor.parse_receipts(lines).where("valid and status = 'ok'")
    out = export.record(sent(spark, sf_dir), ok)
    return out.select(*KEYS, "rating_set", "rating_before", "green_before", F.array_join("tags", ",").alias("tags"))


def queue_counts(spark, sf_dir):
    d = planned(spark, sf_dir).withColumn("roll", F.concat(F.lit("/photos/"), F.col("folder").cast("string")))
    return editor.pending(editor.queue_lines(d).select("roll", "line"))


def queue_files(spark, sf_dir):
    d = planned(spark, sf_dir).withColumn("roll", F.concat(F.lit("/photos/"), F.col("folder").cast("string")))
    return editor.queue_lines(d).groupBy("name").agg(F.count("*").alias("n"), F.min("line").alias("head"))


def send_report(spark, sf_dir):
    have = images(spark, sf_dir).where("folder % 2 = 0").select(*KEYS)
    d = export.route(planned(spark, sf_dir), have)
    outcome = F.when(F.col("route") == "queue", "queued").when(F.col("file") % 23 == 0, "failed").otherwise("written")
    lost = applied(spark, sf_dir).where("status = 'missing' and folder % 2 = 0").select("folder", F.lit("missing").alias("outcome"))
    return export.report(d.select("folder", outcome.alias("outcome")).unionByName(lost))


def dry_run(spark, sf_dir):
    have = images(spark, sf_dir).where("folder % 2 = 0").select(*KEYS)
    return export.route(planned(spark, sf_dir), have).groupBy("route", "rating").agg(F.count("*").alias("n"))


def imported_files(spark, sf_dir):
    """Film rolls from nations, images from customers; all rolls are asked for."""
    rolls = adapters.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("/p/"), "n_name").alias("roll"))
    imgs = adapters.load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("film_id"), F.col("c_name").alias("filename"))
    asked = rolls.select(F.lower("roll").alias("folder"), "roll")
    return editor.imported(rolls, imgs, asked)


def xml_list(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "pages")
    return d.select("page_id", F.array_join(text.list_items(F.col("html"), "p"), "|").alias("items"))


def xml_attr(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "pages")
    return d.select("page_id", text.attribute(F.col("html"), "lang").alias("lang"), text.attribute(F.col("html"), "href").alias("href"), F.length(text.escape(F.col("html"))).alias("escaped"))


#: A sidecar that a user has edited, by the values of its rating, tag and label.
USERS = '<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF>\n  <rdf:Description rdf:about=""\n    xmlns:xmp="http://ns.adobe.com/xap/1.0/"\n    note="a > b"\n   xmp:Rating="%d">\n{lists}   <other>\n    keep  this\n   </other>\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n'
LISTS = "   <lr:hierarchicalSubject>\n    <rdf:Bag>\n     <rdf:li>cull|reason|eyes-closed</rdf:li>\n     <rdf:li>mine|x</rdf:li>\n    </rdf:Bag>\n   </lr:hierarchicalSubject>\n   <darktable:colorlabels>\n    <rdf:Seq>\n     <rdf:li>2</rdf:li>\n    </rdf:Seq>\n   </darktable:colorlabels>\n"


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes with the sidecars before and after them: a third of the files has none yet, a third one with a rating
    alone, a third one with a reject's rating, tags and the green label."""
    d, k = planned(spark, sf_dir), F.col("file").cast("long") % 3
    users = F.when(k == 1, F.format_string(USERS.format(lists=""), (F.col("file").cast("long") % 5 - 1).cast("int"))).when(k == 2, F.format_string(USERS.format(lists=LISTS), F.lit(-1)))
    return d.withColumn("text", users).withColumn("e", xmp.edit_sidecars()("file", "text", "rating", "green", "add", "remove"))


def xmp_edit_roundtrip(spark, sf_dir):
    """Sidecars read back after every change, restores too: rating, tags, labels; whether all else is as it was, and whether
    applying the change again changes nothing."""
    d = edited(spark, sf_dir)
    t = F.col("e.text")
    again = xmp.edit_sidecars()("file", t, "rating", "green", "add", "remove")
    listed = lambda name: text.list_items(t, element=name)
    whole = F.col("text").isNull() | t.contains("   <other>\n    keep  this\n   </other>\n") & t.endswith("\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n") & t.contains('note="a > b"')
    return d.select(*KEYS, xmp.rating(t).alias("rating"), F.array_join(listed(xmp.HIERARCHY), ",").alias("tags"), F.size(listed(xmp.LABELS)).alias("labels"), whole.alias("whole"), (again["text"] == t).alias("same"))


def send_roundtrip(spark, sf_dir):
    """What is sent once all changes have gone their ways: sidecars written, and queues applied whose receipts came back."""
    have = images(spark, sf_dir).where("folder % 2 = 0 and duplicate = 0").select(*KEYS).distinct()
    routed = export.route(edited(spark, sf_dir), have)
    written = routed.where("route = 'sidecar' and e.error is null").select(*KEYS, F.lit(1).alias("seq"), "rating", "green", "add", "remove", F.col("e.before_rating").alias("before_rating"), F.col("e.before_green").alias("before_green"))
    queued = routed.where("route = 'queue'").drop("route", "text", "e")
    lines = editor.receipt_lines(export.apply_changes(images(spark, sf_dir), queued)).select("folder", F.lit(1).alias("seq"), "line")
    back = editor.parse_receipts(lines).where("valid and status = 'ok'")
    out = export.record(sent(spark, sf_dir), written.unionByName(back.select(*written.columns)))
    return out.select(*KEYS, "rating_set", "rating_before", "green_before", F.array_join("tags", ",").alias("tags"))


PLAN = f"""t as (select folder, file, rating, green, case when o_orderstatus = 'F' then ['cull|reason|eyes-closed', 'cull|reason|soft-eyes'] else ['cull|reason|sharpest', 'cull|reason|smile'] end as tags from ({duck('targets')})),
s as (select folder, file, rating_set, rating_before, green_before, case when o_orderkey % 3 = 0 then ['cull|reason|eyes-closed'] when o_orderkey % 3 = 1 then ['cull|reason|smile', 'mine|x'] else [] end as tags from ({duck('sent')})),
j as (select coalesce(t.folder, s.folder) as folder, coalesce(t.file, s.file) as file, t.rating as want, coalesce(t.green, false) as g, coalesce(t.tags, []) as nt, s.rating_set, s.rating_before, s.green_before, coalesce(s.tags, []) as ot, s.file is not null as was from t full join s on t.folder = s.folder and t.file = s.file),
p0 as (select *, case when want is not null and want = rating_set then 'keep' when want is not null then 'set:' || cast(want as string) when rating_set is not null then 'restore:' || cast(rating_set as string) || ':' || cast(rating_before as string) else 'keep' end as rating, case when g and green_before is null then 'set' when not g and green_before is not null then 'restore:' || (case when green_before then '1' else '0' end) else 'keep' end as green, list_sort(list_filter(nt, lambda x: not list_contains(ot, x))) as add, list_sort(list_filter(ot, lambda x: not list_contains(nt, x))) as remove from j),
p as (select * from p0 where rating <> 'keep' or green <> 'keep' or len(add) > 0 or len(remove) > 0)"""
JOIN = "array_to_string({0}, ',')"
LINE = "file || chr(9) || rating || chr(9) || green || chr(9) || (case when len(add) = 0 then '-' else array_to_string(add, ',') end) || chr(9) || (case when len(remove) = 0 then '-' else array_to_string(remove, ',') end)"
IMAGES = "i as (select o_custkey % 50 as folder, cast(o_orderkey as string) as file, cast(o_orderkey % 6 - 1 as int) as r0, o_orderkey % 2 = 0 as g0 from orders where o_orderkey % 10 <> 4)"
APPLIED = "a as (select p.*, r0, g0, i.file is not null as found from p left join i on p.folder = i.folder and p.file = i.file)"
#: What is sent after changes with given values before them; d holds every file's state and its change, if any.
RECORD = """after as (select folder, file, case when done and rating like 'set:%' then cast(substr(rating, 5) as int) when done and rating like 'restore:%' then null else rating_set end as rs,
  case when done and rating like 'set:%' then (case when rating_set is not null then rating_before else b_rating end) when done and rating like 'restore:%' then null else rating_before end as rb,
  case when done and green = 'set' then coalesce(green_before, b_green) when done and green like 'restore:%' then null else green_before end as gb,
  case when done then list_filter(list_distinct(list_concat(ot, add)), lambda x: not list_contains(remove, x)) else ot end as tg from d)
select folder, file, rs as rating_set, rb as rating_before, gb as green_before, array_to_string(list_sort(tg), ',') as tags from after where rs is not null or gb is not null or len(tg) > 0"""
LEVELS = "list_sort(list_distinct(string_split(array_to_string({0}, '|'), '|')))"

ENTRIES = {
    "export_targets": (export_targets, f"with {culling.E}, x as (select *, case when decided = 'reject' then -1 end as rating, decided = 'pick' as green from eff where decided in ('pick', 'reject')) select folder, file, rating, green, case when reasons = '' then '' else array_to_string(list_sort(list_transform(string_split(reasons, ','), lambda r: 'cull|reason|' || r)), ',') end as tags from x"),
    "export_plan": (export_plan, f"with {PLAN} select folder, file, rating, green, {JOIN.format('add')} as add, {JOIN.format('remove')} as remove from p"),
    "export_record": (export_record, f"with {PLAN}, d as (select j.*, p0.rating, p0.green, p0.add, p0.remove, (p0.rating <> 'keep' or p0.green <> 'keep' or len(p0.add) > 0 or len(p0.remove) > 0) as done, 3 as b_rating, false as b_green from j join p0 on j.folder = p0.folder and j.file = p0.file), {RECORD}"),
    "change_lines": (change_lines, f"with {PLAN} select folder, file, {LINE} as line from p"),
    "change_parse": (change_parse, f"with {PLAN} select folder, file, not (folder % 7 = 0 and (rating = 'keep' or green = 'keep')) as valid, case when folder % 7 = 0 then replace(rating, 'keep', 'kept') else rating end as rating, len(add) as n_add, {JOIN.format('remove')} as remove from p"),
    "tag_levels": (tag_levels, f"with {PLAN}, x as (select p.folder, p.file, p.add, p.remove, s.tags, list_sort(list_distinct(list_concat(case when len(s.tags) > 0 then {LEVELS.format('s.tags')} else [] end, ['own']))) as subject, list_sort(list_distinct(list_concat(list_filter(s.tags, lambda t: not list_contains(p.remove, t)), p.add))) as hier from p join s on p.folder = s.folder and p.file = s.file), y as (select *, case when len(hier) > 0 then {LEVELS.format('hier')} else [] end as kept, case when len(remove) > 0 then {LEVELS.format('remove')} else [] end as gone, case when len(add) > 0 then {LEVELS.format('add')} else [] end as new from x) select folder, file, array_to_string(hier, ',') as hierarchy, array_to_string(list_sort(list_distinct(list_concat(list_filter(subject, lambda t: list_contains(kept, t) or not list_contains(gone, t)), new))), ',') as subject from y"),
    "editor_apply": (editor_apply, f"with {PLAN}, {IMAGES}, {APPLIED} select folder, file, case when found then 'ok' else 'missing' end as status, case when found then r0 else 0 end as before_rating, case when found then g0 else false end as before_green, case when not found then null when rating like 'set:%' then cast(substr(rating, 5) as int) when rating like 'restore:%' and cast(string_split(rating, ':')[2] as int) = r0 then cast(string_split(rating, ':')[3] as int) else r0 end as rating_after, case when not found then null when green = 'set' then true when green = 'restore:0' then false else g0 end as green_after from a"),
    "receipts_merge": (receipts_merge, f"with {PLAN}, {IMAGES}, d as (select j.*, p0.rating, p0.green, p0.add, p0.remove, (p0.rating <> 'keep' or p0.green <> 'keep' or len(p0.add) > 0 or len(p0.remove) > 0) and i.file is not null as done, r0 as b_rating, g0 as b_green from j join p0 on j.folder = p0.folder and j.file = p0.file left join i on j.folder = i.folder and j.file = i.file), {RECORD}"),
    "queue_counts": (queue_counts, f"with {PLAN} select '/photos/' || cast(folder as string) as roll, count(*) as waiting from p group by 1"),
    "queue_files": (queue_files, f"with {PLAN} select '%photos%' || cast(folder as string) || '.todo' as name, count(*) + 1 as n, '# queue 1 /photos/' || cast(folder as string) as head from p group by folder"),
    "send_report": (send_report, f"with {PLAN}, {IMAGES}, o as (select p.folder, case when i.file is not null and p.folder % 2 = 0 then 'queued' when cast(p.file as bigint) % 23 = 0 then 'failed' else 'written' end as outcome from p left join i on p.folder = i.folder and p.file = i.file union all select p.folder, 'missing' from p left join i on p.folder = i.folder and p.file = i.file where i.file is null and p.folder % 2 = 0) select folder, count(*) filter (where outcome = 'written') as written, count(*) filter (where outcome = 'queued') as queued, count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'missing') as missing from o group by 1"),
    "dry_run": (dry_run, f"with {PLAN}, {IMAGES} select case when i.file is not null and p.folder % 2 = 0 then 'queue' else 'sidecar' end as route, p.rating, count(*) as n from p left join i on p.folder = i.folder and p.file = i.file group by 1, 2"),
    "imported_files": (imported_files, "select lower('/p/' || n_name) as folder, '/p/' || n_name as roll, c_name as file from nation join customer on n_nationkey = c_nationkey"),
    "xml_list": (xml_list, "select page_id, array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), '|') as items from pages"),
    "xml_attr": (xml_attr, r"""select page_id, case when regexp_matches(html, '\slang="([^"]*)"') then regexp_extract(html, '\slang="([^"]*)"', 1) end as lang, case when regexp_matches(html, '\shref="([^"]*)"') then regexp_extract(html, '\shref="([^"]*)"', 1) end as href, length(html) + 4 * (length(html) - length(replace(html, '&', ''))) + 3 * (length(html) - length(replace(html, '<', ''))) + 3 * (length(html) - length(replace(html, '>', ''))) + 5 * (length(html) - length(replace(html, '"', ''))) as escaped from pages"""),
    "xmp_edit_roundtrip": (
        xmp_edit_roundtrip,
        f"""with {PLAN}, u as (select *, cast(file as bigint) % 3 as k, case cast(file as bigint) % 3 when 1 then cast(file as bigint) % 5 - 1 when 2 then -1 end as cur, case when cast(file as bigint) % 3 = 2 then ['cull|reason|eyes-closed', 'mine|x'] else [] end as h from p)
    select folder, file, cast(case when rating like 'set:%' then cast(substr(rating, 5) as int) when rating like 'restore:%' and cast(split_part(rating, ':', 2) as int) = coalesce(cur, 1) then cast(split_part(rating, ':', 3) as int) else cur end as int) as rating,
    array_to_string(list_sort(list_distinct(list_concat(list_filter(h, lambda t: not list_contains(remove, t)), add))), ',') as tags, case when green = 'set' then 1 when green = 'restore:0' then 0 when k = 2 then 1 else 0 end as labels, true as whole, true as same from u""",
    ),
    "send_roundtrip": (
        send_roundtrip,
        f"""with {PLAN}, {IMAGES}, d as (select j.*, p0.rating, p0.green, p0.add, p0.remove, (p0.rating <> 'keep' or p0.green <> 'keep' or len(p0.add) > 0 or len(p0.remove) > 0) as done,
    case when i.file is not null and j.folder % 2 = 0 then r0 else coalesce(case cast(j.file as bigint) % 3 when 1 then cast(cast(j.file as bigint) % 5 - 1 as int) when 2 then -1 end, 1) end as b_rating,
    case when i.file is not null and j.folder % 2 = 0 then g0 else cast(j.file as bigint) % 3 = 2 end as b_green from j join p0 on j.folder = p0.folder and j.file = p0.file left join i on j.folder = i.folder and j.file = i.file), {RECORD}""",
    ),
}
