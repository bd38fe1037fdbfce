"""Queries on grouping, judging, viewing and calibrating, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotplane.config import KNOBS, CullConfig
from shotplane.functions import faces as faces_of
from shotplane.functions import text
from shotplane.functions.text import badge, eyes_text, lift
from shotplane.functions.vectors import sig_dist
from shotplane.operators import calibrate, group, judge, view
from shotplane.plans import adapters
from shotplane.plans.adapters import duck, face_select
from shotplane.streaming.sessions import gap_sessions

HOUR = 3600.0
GAP = CullConfig(scene_gap=18 * HOUR, orientation_break=False)
BREAK = CullConfig(scene_gap=36 * HOUR)
KEYS = ("folder", "file")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.shots(spark, sf_dir).drop("sig")


def grouped(spark: SparkSession, sf_dir: str, cfg: CullConfig = BREAK) -> DataFrame:
    return group.group(plain(spark, sf_dir), cfg)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge.judge(grouped(spark, sf_dir), BREAK)
    own = adapters.table(spark, sf_dir, "decisions").withColumnRenamed("mark", "decided")
    return d.join(own, list(KEYS), "left").withColumn("effective", judge.effective(F.col("decided"), F.col("mark")))


def group_gap(spark, sf_dir):
    return grouped(spark, sf_dir, GAP).select(*KEYS, "group_id")


def group_gap_break(spark, sf_dir):
    return grouped(spark, sf_dir).select(*KEYS, "group_id")


def group_similar(spark, sf_dir):
    return group.group(adapters.shots(spark, sf_dir), replace(BREAK, split_dist=0.35)).select(*KEYS, "group_id")


def group_stretches(spark, sf_dir):
    """group_similar over stretches of five days."""
    return group.group(adapters.shots(spark, sf_dir), replace(BREAK, split_dist=0.35), stretch=432000.0).select(*KEYS, "group_id")


def regroup_edits(spark, sf_dir):
    d = grouped(spark, sf_dir, GAP)
    return group.regroup(d, d.where("event_id % 13 = 0"), d.where("event_id % 11 = 0")).select(*KEYS, "group_id")


def session_window_gap(spark, sf_dir):
    d = adapters.load(spark, sf_dir, "events").select(F.col("user_id").alias("folder"), F.col("ts").cast("timestamp").alias("ts"), "value")
    s = gap_sessions(d, "6 hours")
    return s.select("folder", F.unix_micros("started").alias("started"), "n", F.round("best", 6).alias("best"))


def judge_scores(spark, sf_dir):
    return judge.judge(grouped(spark, sf_dir), BREAK).select(*KEYS, F.round("rel_sharp", 6).alias("rel_sharp"), F.round("score", 6).alias("score"))


def judge_reasons(spark, sf_dir):
    return judge.judge(grouped(spark, sf_dir), BREAK).select(*KEYS, F.array_join("reasons", ",").alias("reasons"))


def judge_marks(spark, sf_dir):
    return judge.judge(grouped(spark, sf_dir), BREAK).select(*KEYS, "group_id", "mark", F.round("score", 6).alias("score"))


def failed_frames(spark, sf_dir):
    d = group.group(adapters.shots(spark, sf_dir), replace(BREAK, split_dist=0.35))
    return judge.judge(d, BREAK).where("error is not null").select(*KEYS, "mark", F.array_join("reasons", ",").alias("reasons"))


def signature_distance(spark, sf_dir):
    d = adapters.shots(spark, sf_dir)
    return d.select(*KEYS, F.round(sig_dist(F.col("sig"), F.lag("sig").over(group.in_order())), 6).alias("dist"))


def face_shift(spark, sf_dir):
    d = adapters.shots(spark, sf_dir)
    b = F.get(F.col("faces"), F.lit(0))["bbox"]
    held = F.lag(F.struct(b.alias("b"), "width", "height")).over(group.in_order())
    return d.select(*KEYS, F.round(faces_of.face_dist(b, F.col("width"), F.col("height"), held["b"], held["width"], held["height"]), 6).alias("shift")).where("shift is not null")


def eye_states(spark, sf_dir):
    d = plain(spark, sf_dir).select(*KEYS, F.posexplode("faces").alias("face_idx", "f"))
    b = F.col("f.blink")
    return d.select(*KEYS, "face_idx", faces_of.eye_state(b[0]).alias("eye0"), faces_of.eye_state(b[1]).alias("eye1"), faces_of.eyes_closed(b).alias("closed"), eyes_text(b).alias("words"), F.round(lift(F.col("f.face_luma")), 6).alias("lift"))


def filter_tiles(spark, sf_dir):
    d = judged(spark, sf_dir).withColumn("persons", F.array(F.col("event_id") % 4, F.col("event_id") % 9))
    parts = [view.tiles(d, which, hide, person).select(*KEYS, F.lit(which).alias("filter"), F.lit(hide).alias("hide")) for which, hide, person in (("pending", False, None), ("picked", True, 2), ("rejected", True, None), ("all", True, 5))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts_by_group(spark, sf_dir):
    return view.counts(judged(spark, sf_dir), "folder", "group_id")


def cover_frame(spark, sf_dir):
    return view.covers(judged(spark, sf_dir))


def compare_partner(spark, sf_dir):
    return view.partners(judged(spark, sf_dir))


def position_in_group(spark, sf_dir):
    return view.positions(judged(spark, sf_dir)).select(*KEYS, "position", "size", badge(F.col("effective"), F.col("decided").isNotNull()).alias("badge"))


def neighbour_frames(spark, sf_dir):
    return view.neighbours(grouped(spark, sf_dir)).select(*KEYS, "before", "after", "group_before", "group_after")


def judgeable_frames(spark, sf_dir):
    return judged(spark, sf_dir).where(view.judgeable(F.col("reasons"), F.size("faces") > 0)).select(*KEYS)


def serving_view(spark, sf_dir):
    d = judged(spark, sf_dir)
    f = d.select(*KEYS, F.posexplode("faces").alias("face_idx", "f")).select(*KEYS, "face_idx", F.lit(1).alias("person"), eyes_text(F.col("f.blink")).alias("eyes"))
    c = d.where("event_id % 6 = 0").select(*KEYS, F.lit("4:5").alias("ratio"))
    return view.serve(d, f, c).select("folder", "file", F.get_json_object("view", "$.mark").alias("mark"), F.get_json_object("view", "$.decision").alias("decision"), F.get_json_object("view", "$.faces[1].eyes").alias("eyes1"), F.get_json_object("view", "$.crops[0]").alias("crop"))


def decision_changes(spark, sf_dir):
    own = adapters.table(spark, sf_dir, "decisions").withColumn("stars", F.lit(1))
    ch = adapters.table(spark, sf_dir, "frames").where("event_id % 6 < 2")
    one = ch.select("folder", "file", F.lit(1).alias("at"), F.lit("pick").alias("mark"), F.lit(2).alias("stars"))
    two = ch.where("event_id % 5 = 0").select("folder", "file", F.lit(2).alias("at"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("int").alias("stars"))
    return view.decide(own, one.unionByName(two))


def accepted_groups(spark, sf_dir):
    return view.accept(judged(spark, sf_dir)).groupBy("decided").agg(F.count("*").alias("n"))


def visible_groups(spark, sf_dir):
    return view.visible_groups(view.tiles(judged(spark, sf_dir), "rejected"))


def toggles(d: DataFrame, chosen: DataFrame) -> DataFrame:
    """Frames of d among the chosen ones, with their decision after a key for a pick and after their group is marked."""
    whole = view.mark_groups(chosen, "reject").select(*KEYS, F.col("decided").alias("grouped"))
    return d.select(*KEYS, view.toggled(F.col("decided"), "pick").alias("toggled")).join(whole, list(KEYS))


def mark_toggles(spark, sf_dir):
    d = judged(spark, sf_dir)
    return toggles(d, d)


def reason_labels(spark, sf_dir):
    d = judged(spark, sf_dir).select(*KEYS, F.posexplode("reasons").alias("i", "reason"))
    return d.select(*KEYS, "i", text.wording(F.col("reason"), text.REASON_TEXT).alias("label"), text.tone(F.col("reason")).alias("tone"))


def mark_agreement(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "marks")
    parts = [calibrate.agreement(d, m).withColumn("mark", F.lit(m)) for m in ("reject", "pick")]
    return parts[0].unionByName(parts[1]).select("mark", "both", "only_pre", "only_user", "errors", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def reason_stats(spark, sf_dir):
    return calibrate.reason_stats(judged(spark, sf_dir))


def missed_rejects(spark, sf_dir):
    return calibrate.missed_rejects(judged(spark, sf_dir)).select(*KEYS, F.array_join("reasons", ",").alias("reasons"), F.round("rel_sharp", 6).alias("rel_sharp"), F.round(F.get("blink", F.lit(0)), 6).alias("blink0"), F.round(F.get("blink", F.lit(1)), 6).alias("blink1"))


#: All values of one threshold.
SWEEP = next(calibrate.knob_values(*r) for k, *r in KNOBS if k == "soft_rel")


def knob_sweep(spark, sf_dir):
    own = adapters.table(spark, sf_dir, "decisions")
    return calibrate.swept(grouped(spark, sf_dir), own, BREAK, "soft_rel", SWEEP).select("value", "errors")


def calibrate_search(spark, sf_dir):
    """Rounds over the five thresholds until none moves, three at most: a loop of jobs, one for each threshold."""
    d, own = grouped(spark, sf_dir), adapters.table(spark, sf_dir, "decisions")
    best, before, after = calibrate.calibrate(d, own, BREAK)
    rows = calibrate.suggestions(BREAK, best) or [("none", 0.0, 0.0)]
    return spark.createDataFrame([(k, a, b, before, after) for k, a, b in rows], "param string, current double, suggested double, errors_before long, errors_after long")


# ---- SQL --------------------------------------------------------------------------------------------------------

FRAMES = f"frames as ({duck('frames')}), ordered as (select *, lag(time) over w as pt, lag(width) over w as pw, lag(height) over w as ph, lag(failed) over w as pf, lag(faceless) over w as pn, lag(s0) over w as p0, lag(s1) over w as p1, lag(s2) over w as p2, lag(s3) over w as p3, lag(event_id) over w as pe from frames window w as (partition by folder order by time, file))"
DIST = "case when failed or coalesce(pf, true) then 1.0 else (abs(s0 - p0) + abs(s1 - p1) + abs(s2 - p2) + abs(s3 - p3)) / (4 * 255e0) end"


def box(event: str, name: str) -> str:
    return adapters.FACE[name].format(k=0).replace("event_id", event)


SHIFT = f"case when not faceless and not pn then abs(({box('event_id', 'bx')} + {box('event_id', 'bw')} / 2) / width - ({box('pe', 'bx')} + {box('pe', 'bw')} / 2) / pw) + abs(({box('event_id', 'by')} + {box('event_id', 'bh')} / 2) / height - ({box('pe', 'by')} + {box('pe', 'bh')} / 2) / ph) + abs(ln({box('event_id', 'bw')} / {box('pe', 'bw')})) end"


def grouping(new: str) -> str:
    return f"{FRAMES}, grouped as (select *, cast(sum(case when pt is null or {new} then 1 else 0 end) over (partition by folder order by time, file rows unbounded preceding) - 1 as bigint) as group_id from ordered)"


G_GAP = grouping("time - pt > 64800")
G_BREAK = grouping("time - pt > 129600 or (width > height) <> (pw > ph)")
G_SIM = grouping(f"time - pt > 129600 or (width > height) <> (pw > ph) or {DIST} + 0.5e0 * coalesce({SHIFT}, 0) > 0.35e0")


def judging(groups: str) -> str:
    face_rows = " union all ".join(f"select folder, file, {k} as k, {face_select(k)} from frames where not faceless" for k in (0, 1))
    return f"""{groups}, faces as ({face_rows}),
    usable as (select *, greatest(blink0, blink1) >= 0.45e0 and least(blink0, blink1) >= 0.3e0 as shut from faces where presence >= 0.5e0 and greatest(eye_px0, eye_px1) >= 40),
    worst as (select folder, file, bool_or(shut) as closed, min(greatest(eye_sharp0, eye_sharp1)) as sharp, min(smile) as smile, bool_or(cut) as cut from usable group by 1, 2),
    all_faces as (select folder, file, bool_and(presence < 0.5e0) as hidden from faces group by 1, 2),
    r as (select g.*, w.file is not null as has_face, coalesce(w.closed, false) as closed, coalesce(w.sharp, case when g.failed then 0 else g.frame_sharp end) as sharp, coalesce(w.smile, 0) as smile, coalesce(w.cut, false) as cut,
      case when w.file is not null then null when g.faceless then 'no-face' when a.hidden then 'face-hidden' else 'small-face' end as why
      from grouped g left join worst w on g.folder = w.folder and g.file = w.file left join all_faces a on g.folder = a.folder and g.file = a.file),
    b as (select *, coalesce(max(case when has_face and not closed then greatest(sharp, 0) end) over p, 0) as best_face, coalesce(max(case when not has_face then greatest(sharp, 0) end) over p, 0) as best_frame, sum(case when has_face then 1 else 0 end) over p as n_face, count(*) over p as n from r window p as (partition by folder, group_id)),
    rel as (select *, case when (case when has_face then best_face else best_frame end) > 0 then least(sharp / (case when has_face then best_face else best_frame end), 1) else 0 end as rel_sharp from b),
    soft as (select *, has_face and n_face >= 2 and best_face > 0 and rel_sharp < 0.5e0 as soft_eyes from rel),
    sc as (select *, closed or soft_eyes as rejected, case when has_face then rel_sharp * (case when closed then 0.3e0 else 1e0 end) * (case when cut then 0.9e0 else 1e0 end) + smile * 0.05e0 else rel_sharp * 0.9e0 end as score from soft),
    rk as (select *, row_number() over q as rank, first_value(score) over q as top from sc window q as (partition by folder, group_id, rejected order by score desc, time, file)),
    pk as (select *, not rejected and rank <= 1 + (case when n >= 8 then 1 else 0 end) + (case when n >= 16 then 1 else 0 end) and score >= top * 0.9e0 as pick from rk),
    judged as (select *, case when rejected then 'reject' when pick then 'pick' else 'none' end as mark,
      concat_ws(',', case when pick and rel_sharp >= 0.999e0 and has_face then 'sharpest' end, case when closed then 'eyes-closed' end, case when soft_eyes then 'soft-eyes' end, case when cut then 'face-cut' end, case when has_face and smile > 0.5e0 then 'smile' end, why, case when not has_face and n - n_face >= 2 and rel_sharp < 0.6e0 then 'soft-frame' end) as reasons from pk)"""


J = judging(G_BREAK)
E = f"{J}, dec as ({duck('decisions')}), eff as (select j.*, d.mark as decided, coalesce(d.mark, j.mark) as effective from judged j left join dec d on j.folder = d.folder and j.file = d.file)"
WORDS = "case when greatest(blink0, blink1) >= 0.45e0 and least(blink0, blink1) >= 0.3e0 then 'eyes closed' when greatest(blink0, blink1) >= 0.45e0 then 'one eye closed' when greatest(blink0, blink1) >= 0.3e0 then 'half-closed' else 'eyes open' end"
STATE = "case when {b} >= 0.45e0 then 'closed' when {b} >= 0.3e0 then 'half' else 'open' end"
FACES = " union all ".join(f"select folder, file, event_id, {k} as k, {face_select(k)} from frames where not faceless" for k in (0, 1))


def sweep_sql() -> str:
    parts = []
    for v in SWEEP:
        j = J.replace("rel_sharp < 0.5e0 as soft_eyes", f"rel_sharp < {v}e0 as soft_eyes")
        parts.append(f"select cast({v} as double) as value, cast(sum(case when (mark = 'reject') <> (dmark = 'reject') then 1 else 0 end) as bigint) as errors from (with {j}, dec as ({duck('decisions')}) select j.mark, d.mark as dmark from judged j join dec d on j.folder = d.folder and j.file = d.file)")
    return " union all ".join(parts)


AGREE = "select '{m}' as mark, count(*) filter (where p and u) as both, count(*) filter (where p and not u) as only_pre, count(*) filter (where not p and u) as only_user, count(*) filter (where p <> u) as errors, round(count(*) filter (where p and u) / nullif(cast(count(*) filter (where p) as double), 0), 6) as precision, round(count(*) filter (where p and u) / nullif(cast(count(*) filter (where u) as double), 0), 6) as recall from (select predicted = '{m}' as p, decided = '{m}' as u from m)"

ENTRIES = {
    "group_gap": (group_gap, f"with {G_GAP} select folder, file, group_id from grouped"),
    "group_gap_break": (group_gap_break, f"with {G_BREAK} select folder, file, group_id from grouped"),
    "group_similar": (group_similar, f"with {G_SIM} select folder, file, group_id from grouped"),
    "group_stretches": (group_stretches, f"with {G_SIM} select folder, file, group_id from grouped"),
    "regroup_edits": (regroup_edits, f"with {G_GAP}, x as (select *, lag(group_id) over (partition by folder order by time, file) as pg from grouped) select folder, file, cast(sum(case when pg is null or (event_id % 11 <> 0 and (pg <> group_id or event_id % 13 = 0)) then 1 else 0 end) over (partition by folder order by time, file rows unbounded preceding) - 1 as bigint) as group_id from x"),
    "session_window_gap": (session_window_gap, "with e as (select user_id as folder, epoch_us(ts) as t, value, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as p from events), g as (select *, sum(case when p is null or t - p > 21600000000 then 1 else 0 end) over (partition by folder order by t rows unbounded preceding) as k from e) select folder, min(t) as started, count(*) as n, round(max(value), 6) as best from g group by folder, k"),
    "judge_scores": (judge_scores, f"with {J} select folder, file, round(rel_sharp, 6) as rel_sharp, round(score, 6) as score from judged"),
    "judge_reasons": (judge_reasons, f"with {J} select folder, file, reasons from judged"),
    "judge_marks": (judge_marks, f"with {J} select folder, file, group_id, mark, round(score, 6) as score from judged"),
    "failed_frames": (failed_frames, f"with {judging(G_SIM)} select folder, file, mark, reasons from judged where failed"),
    "signature_distance": (signature_distance, f"with {FRAMES} select folder, file, round({DIST}, 6) as dist from ordered"),
    "face_shift": (face_shift, f"with {FRAMES} select * from (select folder, file, round({SHIFT}, 6) as shift from ordered) where shift is not null"),
    "eye_states": (eye_states, f"with {FRAMES}, f as ({FACES}) select folder, file, k as face_idx, {STATE.format(b='blink0')} as eye0, {STATE.format(b='blink1')} as eye1, greatest(blink0, blink1) >= 0.45e0 and least(blink0, blink1) >= 0.3e0 as closed, {WORDS} as words, round(case when luma <= 0 then 1 else greatest(1e0, least(3e0, 110e0 / luma)) end, 6) as lift from f"),
    "filter_tiles": (filter_tiles, f"with {E} select folder, file, 'pending' as filter, false as hide from eff where decided is null union all select folder, file, 'picked', true from eff where decided = 'pick' and (event_id % 4 = 2 or event_id % 9 = 2) union all select folder, file, 'rejected', true from eff where decided = 'reject' union all select folder, file, 'all', true from eff where coalesce(decided <> 'reject', true) and event_id % 9 = 5"),
    "counts_by_group": (counts_by_group, f"with {E} select folder, group_id, count(*) as n, count(*) filter (where effective = 'pick') as picks, count(*) filter (where decided = 'reject') as rejects, count(*) filter (where decided is null) as pending from eff group by 1, 2"),
    "cover_frame": (cover_frame, f"with {E} select folder, group_id, file as cover from (select *, row_number() over (partition by folder, group_id order by case when effective = 'pick' then 0 else 1 end, time, file) as k from eff) where k = 1"),
    "compare_partner": (compare_partner, f"with {E} select folder, group_id, file, partner from (select a.folder, a.group_id, a.file, b.file as partner, row_number() over (partition by a.folder, a.group_id, a.file order by case when b.effective = 'pick' then 0 else 1 end, b.score desc, b.time, b.file) as k from eff a join eff b on a.folder = b.folder and a.group_id = b.group_id and a.file <> b.file) where k = 1"),
    "position_in_group": (position_in_group, f"with {E} select folder, file, row_number() over (partition by folder, group_id order by time, file) as position, count(*) over (partition by folder, group_id) as size, case when decided is null then '(' else '' end || case when effective = 'pick' then '★' when effective = 'reject' then '✗' else '?' end || case when decided is null then ')' else '' end as badge from eff"),
    "neighbour_frames": (neighbour_frames, f"with {G_BREAK}, h as (select folder, group_id, file from (select *, row_number() over (partition by folder, group_id order by time, file) as k from grouped) where k = 1), n as (select folder, group_id, lag(file) over w as gb, lead(file) over w as ga from h window w as (partition by folder order by group_id)) select g.folder, g.file, lag(g.file) over w as before, lead(g.file) over w as after, n.gb as group_before, n.ga as group_after from grouped g join n on g.folder = n.folder and g.group_id = n.group_id window w as (partition by g.folder order by g.time, g.file)"),
    "judgeable_frames": (judgeable_frames, f"with {J} select folder, file from judged where not faceless and has_face"),
    "serving_view": (serving_view, f"with {E}, f as ({FACES}) select e.folder, e.file, e.mark, e.decided as decision, f.words as eyes1, case when e.event_id % 6 = 0 then '4:5' end as crop from eff e left join (select folder, file, {WORDS} as words from f where k = 1) f on e.folder = f.folder and e.file = f.file"),
    "decision_changes": (decision_changes, f"with frames as ({duck('frames')}), dec as ({duck('decisions')}) select f.folder, f.file, case when event_id % 6 < 2 then 'pick' else d.mark end as mark, case when event_id % 6 < 2 then 2 else 1 end as stars from frames f left join dec d on f.folder = d.folder and f.file = d.file where (event_id % 6 < 2 and event_id % 5 <> 0) or (event_id % 6 >= 2 and d.mark is not null)"),
    "accepted_groups": (accepted_groups, f"with {E} select effective as decided, count(*) as n from eff group by 1"),
    "visible_groups": (visible_groups, f"with {E} select folder, group_id, row_number() over (partition by folder order by group_id) as place from (select distinct folder, group_id from eff where decided = 'reject')"),
    "mark_toggles": (mark_toggles, f"with {E}, g as (select folder, group_id, bool_and(coalesce(decided, '') = 'reject') as has from eff group by 1, 2) select e.folder, e.file, case when e.decided = 'pick' then 'none' else 'pick' end as toggled, case when g.has then 'none' else 'reject' end as grouped from eff e join g on e.folder = g.folder and e.group_id = g.group_id"),
    "reason_labels": (reason_labels, f"with {E}, x as (select folder, file, unnest(string_split(reasons, ',')) as reason, unnest(range(0, len(string_split(reasons, ',')))) as i from eff where reasons <> '') select folder, file, i, case reason when 'soft-frame' then 'soft' else replace(reason, '-', ' ') end as label, case when reason in ('eyes-closed', 'soft-eyes', 'soft-frame', 'face-cut') then 'bad' when reason in ('sharpest', 'smile') then 'good' else 'info' end as tone from x"),
    "mark_agreement": (mark_agreement, f"with m as ({duck('marks')}) " + " union all ".join(AGREE.format(m=m) for m in ("reject", "pick"))),
    "reason_stats": (reason_stats, f"with {E}, x as (select decided, unnest(string_split(reasons, ',')) as reason from eff where decided is not null and reasons <> '') select reason, count(*) as flagged, count(*) filter (where decided = 'reject') as rejected, count(*) filter (where decided = 'pick') as picked from x group by 1"),
    "missed_rejects": (missed_rejects, f"with {E}, f as (select folder, file, blink0, blink1 from (select *, row_number() over (partition by folder, file order by least(blink0, blink1) desc, k desc) as n from faces) where n = 1) select e.folder, e.file, e.reasons, round(e.rel_sharp, 6) as rel_sharp, round(f.blink0, 6) as blink0, round(f.blink1, 6) as blink1 from eff e left join f on e.folder = f.folder and e.file = f.file where e.decided = 'reject' and e.mark <> 'reject'"),
    "knob_sweep": (knob_sweep, sweep_sql()),
    "calibrate_search": (calibrate_search, None),
}
