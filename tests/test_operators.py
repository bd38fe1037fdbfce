import itertools
import os
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotplane import schema
from shotplane.config import CullConfig, DetectConfig, PeopleConfig
from shotplane.functions import exif, hashing, text, vectors, xmp
from shotplane.operators import calibrate, detect, export, graph, group, image, judge, people, view
from shotplane.plans import flows
from shotplane.sources import editor, listing, state


def face(blink=(0.1, 0.1), sharp=10.0, smile=0.0, cut=False, presence=0.9, px=60.0, box=(100.0, 100.0, 300.0, 400.0)):
    return {"bbox": list(box), "presence": presence, "eye_px": [px, px], "eye_sharp": [sharp, sharp], "blink": list(blink), "smile": smile, "cut": cut}


def frame(file, time=0.0, faces=(), sharp=5.0, wide=True, sig=(10, 20, 30)):
    return {"folder": "f", "file": file, "time": float(time), "width": 6000 if wide else 4000, "height": 4000 if wide else 6000, "faces": list(faces), "frame_sharp": sharp, "sig": list(sig)}


TYPE = "folder string, file string, time double, width int, height int, faces array<struct<bbox:array<double>,presence:double,eye_px:array<double>,eye_sharp:array<double>,blink:array<double>,smile:double,cut:boolean>>, frame_sharp double, sig array<smallint>"


def shots(spark, rows):
    return spark.createDataFrame([tuple(r[k.split(" ")[0]] if k.split(" ")[0] != "faces" else [tuple(f.values()) for f in r["faces"]] for k in ("folder", "file", "time", "width", "height", "faces", "frame_sharp", "sig")) for r in rows], TYPE)


def marks(df):
    return {r.file: (r.mark, list(r.reasons)) for r in df.collect()}


# ---- grouping and judging ---------------------------------------------------------------------------------------


def test_groups_split_on_gap_orientation_and_content(spark):
    rows = [frame("a", 0), frame("b", 45), frame("c", 90.5), frame("d", 91, wide=False), frame("e", 92, wide=False, sig=(200, 200, 200)), frame("f", 93, wide=False, sig=(200, 200, 200), faces=[face()]), frame("g", 94, wide=False, sig=(200, 200, 200), faces=[face(box=(2000.0, 3000.0, 900.0, 900.0))]), frame("h", 95, sig=()), frame("i", 95, sig=())]
    got = {r.file: r.group_id for r in group.group(shots(spark, rows)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 3, "f": 3, "g": 4, "h": 5, "i": 6}


def test_a_join_beats_a_split(spark):
    d = group.group(shots(spark, [frame(x, 100 * i) for i, x in enumerate("abcd")]))
    f = lambda *x: spark.createDataFrame([("f", k) for k in x], "folder string, file string")
    got = {r.file: r.group_id for r in group.regroup(d, f("c", "b"), f("a", "b", "d")).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_marks_in_one_group(spark):
    rows = [frame("open", 0, [face()]), frame("soft", 1, [face(sharp=4.0)]), frame("shut", 2, [face(blink=(0.9, 0.8), sharp=20.0)]), frame("wink", 3, [face(blink=(0.9, 0.1), sharp=9.5, smile=0.8)]), frame("none", 4, sharp=8.0), frame("small", 5, [face(px=10.0)], sharp=3.0), frame("hidden", 6, [face(presence=0.1)], sharp=7.0)]
    got = marks(judge.judge(group.group(shots(spark, rows)).withColumn("group_id", F.lit(0))))
    assert got == {
        "open": ("pick", ["sharpest"]),
        "soft": ("reject", ["soft-eyes"]),
        "shut": ("reject", ["eyes-closed"]),
        "wink": ("none", ["smile"]),
        "none": ("none", ["no-face"]),
        "small": ("none", ["small-face", "soft-frame"]),
        "hidden": ("none", ["face-hidden"]),
    }


@pytest.mark.parametrize("n,picks", [(7, 1), (8, 2), (15, 2), (16, 3)])
def test_large_groups_have_more_picks(spark, n, picks):
    rows = [frame(f"{i:02}", i, [face(sharp=10 - i / 100)]) for i in range(n)]
    got = marks(judge.judge(shots(spark, rows).withColumn("group_id", F.lit(0))))
    assert [k for k, (m, _) in sorted(got.items()) if m == "pick"] == [f"{i:02}" for i in range(picks)]


def test_failed_frames_are_picks(spark):
    row = frame("x", 0, sharp=0.0, sig=()) | {"width": 0, "height": 0}
    assert marks(judge.judge(group.group(shots(spark, [row])))) == {"x": ("pick", ["no-face"])}


def test_calibration_moves_a_threshold(spark):
    rows = [frame(f"{i}", 100 * i, [face(blink=(0.42, 0.4))]) for i in range(4)] + [frame(f"o{i}", 5000 + 100 * i, [face(blink=(0.2, 0.2))]) for i in range(4)]
    d = group.group(shots(spark, rows))
    own = spark.createDataFrame([("f", f"{i}", "reject") for i in range(4)] + [("f", f"o{i}", "pick") for i in range(4)], "folder string, file string, mark string")
    best, before, after = calibrate.calibrate(d, own, rounds=1)
    assert (before, after) == (4, 0)
    assert [(k, a, round(b, 4)) for k, a, b in calibrate.suggestions(CullConfig(), best)] == [("blink_closed", 0.45, 0.4)]
    j = judge.judge(d).join(own.withColumnRenamed("mark", "decided"), ["folder", "file"])
    assert sorted((r.file, list(r.blink)) for r in calibrate.missed_rejects(j).collect()) == [(f"{i}", [0.42, 0.4]) for i in range(4)]
    a = calibrate.agreement(j.withColumn("predicted", F.col("mark")), "reject").first()
    assert (a["both"], a["only_pre"], a["only_user"], a["precision"], a["recall"]) == (0, 0, 4, None, 0.0)


# ---- people -----------------------------------------------------------------------------------------------------


def naive_linkage(v, thr):
    groups = [[i] for i in range(len(v))]
    while True:
        best = max(((np.mean([v[a] @ v[b] for a in x for b in y]), -i, -j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2)), default=(thr, 0, 0))
        if not best[0] > thr:
            return sorted((sorted(g) for g in groups), key=lambda g: (-len(g), g[0]))
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
        groups.sort(key=lambda g: min(g))


def test_nearest_equals_brute_force_over_blocks(spark):
    r = np.random.default_rng(4)
    left, right = r.standard_normal((70, 5)).round(1), r.standard_normal((40, 5)).round(1)
    a = spark.createDataFrame([("fg"[i % 2], i, v.tolist()) for i, v in enumerate(left)], "folder string, k long, v array<double>")
    b = spark.createDataFrame([("fg"[i % 2], i, v.tolist()) for i, v in enumerate(right)], "folder string, place long, v array<double>")
    for scope, keys in (([], ["k"]), (["folder"], ["folder", "k"])):
        got = {x.k: x.place for x in people.nearest(a, b, keys, 1.0, scope, block=9).collect()}
        want = {}
        for i, v in enumerate(left):
            some = [(float(v @ w), j) for j, w in enumerate(right) if not scope or i % 2 == j % 2]
            if max(some)[0] > 1.0:
                want[i] = max(some)[1]
        assert got == want
    assert people.nearest(a, b.limit(0), ["k"], 1.0, []).count() == 0


def test_names_differ_by_other_letters_than_a_to_z(spark):
    lib = library(spark, [(1, "ÉVA", [[1.0]]), (2, "Ann", [[2.0]])]).drop("pos")
    more = spark.createDataFrame([("éva", [[3.0]]), ("ANN ", [[4.0]])], "name string, embeds array<array<double>>")
    assert sorted((r.id, r.name, len(r.samples)) for r in people.learn(lib, more).collect()) == [(1, "ÉVA", 1), (2, "Ann", 2), (3, "éva", 1)]
    assert sorted((r.id, r.name) for r in people.rename(lib, 2, "éva").collect()) == [(1, "ÉVA"), (2, "éva")]
    assert sorted((r.id, len(r.samples)) for r in people.rename(lib, 1, "aNN").collect()) == [(2, 2)]


def test_photos_of_one_name_have_their_own_times(spark):
    files = spark.createDataFrame([("a", "x.CR3"), ("b", "x.CR3")], "folder string, file string")
    rows = spark.createDataFrame([("a/x.CR3", 1, "2024:01:01 00:00:01", None), ("b/x.CR3", 3, "2024:01:01 00:00:02", None)], schema.EXIF)
    got = listing.scan(files, listing.exif_rows(rows)).collect()
    assert [(r.folder, r.orientation) for r in got] == [("a", 1), ("b", 3)] and got[1].time - got[0].time == 1


def test_groups_do_not_depend_on_stretches(spark):
    r = random.Random(3)
    rows = [{**frame(f"{i:03}", r.choice([i * 50.0, i * 7.0, 0.0]), wide=r.random() < 0.8, sig=(r.randrange(40),) * 3), "folder": r.choice("fg")} for i in range(200)]
    d = spark.createDataFrame([tuple(x.values()) for x in rows], TYPE)
    d = d.withColumn("time", F.when(F.col("file") == "007", None).otherwise(F.col("time")))
    sets = []
    for stretch in (1.0, 60.0, 1e9):
        g = group.group(d, CullConfig(split_dist=0.05), stretch=stretch)
        e = group.regroup(g, d.where("file like '%5'"), d.where("file like '%8'"), stretch=stretch)
        sets.append((sorted((x.folder, x.file, x.group_id) for x in g.collect()), sorted((x.folder, x.file, x.group_id) for x in e.collect())))
    assert sets[0] == sets[1] == sets[2] and len(sets[0][0]) == 200 and sets[0][0] != sets[0][1]


def test_linkage_equals_the_naive_one():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 9, 25):
        v = r.standard_normal((n, 6))
        v /= np.linalg.norm(v, axis=1, keepdims=True) if n else 1
        assert people.average_linkage(v, 0.3) == naive_linkage(v, 0.3)


def test_clusters_of_components_equal_those_of_folders(spark):
    r = np.random.default_rng(9)
    rows = []
    for folder in ("f", "g"):
        base = r.standard_normal((6, 8))
        v = np.concatenate([base + 0.5 * r.standard_normal(base.shape) for _ in range(5)])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows += [(folder, f"{i:02}", 0, i, x.tolist()) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "folder string, file string, face_idx int, ord int, embed array<double>")
    got = {(x.folder, x.file): x.cluster for x in people.cluster(d, 0.4).collect()}
    for folder in ("f", "g"):
        want = people.average_linkage(np.array([x[4] for x in rows if x[0] == folder]), 0.4)
        assert {(folder, f"{i:02}"): k for k, m in enumerate(want) for i in m} == {k: c for k, c in got.items() if k[0] == folder}
    small = people.similar_pairs(d, 0.4, block=7).collect()
    assert len(small) == people.similar_pairs(d, 0.4).count() == len({tuple(x)[:5] for x in small})


def library(spark, rows):
    return spark.createDataFrame([(*r, r[0]) for r in rows], "id long, name string, samples array<array<double>>, pos long")


def test_people_of_a_folder(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v, k: (np.array(v) + 0.05 * np.array([k, -k, 1])).tolist()
    rows = [("f", f"{i}", 0, i, near(v, i % 3), n, p) for i, (v, n, p) in enumerate([(a, 12.0, 0.9), (a, 12.0, 0.9), (b, 12.0, 0.9), (b, 11.0, 0.9), (b, 12.0, 0.9), (c, 12.0, 0.9), (a, 6.0, 0.2), (c, 6.0, 0.9), (b, 3.0, 0.9)])]
    faces = spark.createDataFrame(rows, "folder string, file string, face_idx int, ord int, embed array<double>, embed_norm double, presence double")
    fixes = spark.createDataFrame([("f", "4:0", 0), ("f", "5:0", 7), ("f", "9:0", 7), ("f", "odd", 7)], "folder string, key string, person_id long")
    got = people.people(faces, library(spark, [(7, "Ann", [a]), (8, "Bo", [[0.0, -1.0, 0.0]])]), fixes)
    assert [(r.person_id, r.name, list(r.faces)) for r in got.orderBy("place").collect()] == [(7, "Ann", ["0:0", "1:0", "5:0", "6:0"]), (1001, None, ["2:0", "3:0"])]
    assert [r.shown for r in people.numbered(got).orderBy("place").collect()] == ["Ann", "Person 1"]


def test_library_learns_merges_and_forgets(spark):
    cfg = PeopleConfig(samples=4)
    lib = library(spark, [(1, "Ann", [[1.0]]), (5, "Bo", [[2.0], [3.0]])]).drop("pos")
    new = spark.createDataFrame([(" ANN ", [[float(k)] for k in range(10, 20)]), ("Cy", [[9.0]])], "name string, embeds array<array<double>>")
    got = {r.id: (r.name, [s[0] for s in r.samples]) for r in people.learn(lib, new, cfg).collect()}
    assert got == {1: ("Ann", [10.0, 12.0, 15.0, 17.0]), 5: ("Bo", [2.0, 3.0]), 6: ("Cy", [9.0])}
    state_of = lambda d: sorted((r.id, r.name, [s[0] for s in r.samples]) for r in d.collect())
    assert state_of(people.rename(lib, 5, "ann", cfg)) == [(1, "Ann", [1.0, 2.0, 3.0])]
    assert state_of(people.rename(lib, 5, "Di", cfg)) == [(1, "Ann", [1.0]), (5, "Di", [2.0, 3.0])]
    assert state_of(people.rename(lib, 5, " ", cfg)) == [(1, "Ann", [1.0])]
    assert state_of(people.rename(lib, 9, "Ann", cfg)) == [(1, "Ann", [1.0]), (5, "Bo", [2.0, 3.0])]


# ---- export -----------------------------------------------------------------------------------------------------

SENT = "folder string, file string, rating_set int, rating_before int, green_before boolean, tags array<string>"
TARGET = "folder string, file string, rating int, green boolean, tags array<string>"


def state_of_sent(d):
    return sorted((r.file, r.rating_set, r.rating_before, r.green_before, tuple(r.tags)) for r in d.collect())


def applied(plan, before_rating, before_green):
    return plan.withColumns({"seq": F.lit(1), "before_rating": F.lit(before_rating), "before_green": F.lit(before_green)})


def test_resending_is_idempotent_and_reversible(spark):
    none = spark.createDataFrame([], SENT)
    want = spark.createDataFrame([("f", "a", -1, False, ["t|x"]), ("f", "b", None, True, ["t|y"])], TARGET)
    plan = export.plan(want, none)
    sent = export.record(none, applied(plan, 3, False)).cache()
    assert state_of_sent(sent) == [("a", -1, 3, None, ("t|x",)), ("b", None, None, False, ("t|y",))]
    assert export.plan(want, sent).count() == 0
    back = export.plan(spark.createDataFrame([], TARGET), sent)
    assert sorted((r.file, r.rating, r.green, list(r.remove)) for r in back.collect()) == [("a", "restore:-1:3", "keep", ["t|x"]), ("b", "keep", "restore:0", ["t|y"])]
    assert state_of_sent(export.record(sent, applied(back, -1, True))) == []


def test_the_first_value_before_is_kept(spark):
    none = spark.createDataFrame([], SENT)
    steps = spark.createDataFrame([("f", "a", 1, "set:-1", "keep", [], [], 4, False), ("f", "a", 2, "set:2", "set", ["z"], [], -1, True), ("f", "a", 3, "keep", "keep", ["y"], ["z"], 0, False)], "folder string, file string, seq int, rating string, green string, add array<string>, remove array<string>, before_rating int, before_green boolean")
    assert state_of_sent(export.record(none, steps)) == [("a", 2, 4, True, ("y",))]


def test_change_lines_go_round(spark):
    rows = [("a.CR3", "keep", "set", ["x", "y|z"], []), ("b", "set:-1", "keep", [], ["q"]), ("c", "restore:-1:3", "restore:1", [], [])]
    d = spark.createDataFrame(rows, "file string, rating string, green string, add array<string>, remove array<string>")
    lines = d.select(text.change_line(*(F.col(c) for c in d.columns)).alias("line"))
    p = text.parse_change(F.col("line"))
    got = lines.select(*(c.alias(k) for k, c in p.items())).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r) for r in rows] and all(r.valid for r in got)
    bad = spark.createDataFrame([("a\tkept\tset\t-\t-",), ("a\tset:x\tset\t-\t-",), ("a\tkeep",)], "line string")
    assert not any(r.valid for r in bad.select(p["valid"].alias("valid")).collect())


def test_receipts_flow_through_files_and_a_stream(spark, tmp_path):
    from shotplane.streaming.receipts import follow_receipts

    want = spark.createDataFrame([("r1", "a", -1, False, ["t|x"]), ("r1", "b", None, True, []), ("r2", "c", -1, False, [])], TARGET)
    plan = export.plan(want, spark.createDataFrame([], SENT))
    editor.write_queue(plan.withColumn("roll", F.concat(F.lit("/p/"), "folder")), f"{tmp_path}/queue")
    lines = spark.read.text(f"{tmp_path}/queue")
    assert {r["name"] for r in lines.select("name").distinct().collect()} == {"%p%r1.todo", "%p%r2.todo"}
    assert lines.where("value like '#%'").count() == 2 and lines.count() == 5
    images = spark.createDataFrame([("r1", "a", 3, False, 0), ("r1", "a", 5, True, 1), ("r1", "b", 0, False, 0)], "folder string, file string, rating int, green boolean, duplicate int")
    done = export.apply_changes(images, plan)
    assert {(r.file, r.status, r.rating_after, r.green_after) for r in done.collect()} == {("a", "ok", -1, False), ("b", "ok", 0, True), ("c", "missing", None, None)}
    editor.receipt_lines(done).select("folder", F.col("line").alias("value")).coalesce(1).write.partitionBy("folder").text(f"{tmp_path}/done")
    q = follow_receipts(spark, f"{tmp_path}/done", f"{tmp_path}/state", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert q.exception() is None
    last = max(os.listdir(f"{tmp_path}/state"))
    assert state_of_sent(spark.read.parquet(f"{tmp_path}/state/{last}")) == [("a", -1, 3, None, ("t|x",)), ("b", None, None, False, ())]


# ---- sidecars ---------------------------------------------------------------------------------------------------


def sidecar(body="", attrs='\n   xmp:Rating="3"'):
    return f'<?xml version="1.0"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF>\n  <rdf:Description rdf:about=""\n    xmlns:xmp="http://ns.adobe.com/xap/1.0/"\n    note=\'a > "b"\'{attrs}>\n{body}   <other>\n    keep  this\n   </other>\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n'


def listed(text_, name):
    return xmp.State.of(text_, xmp.Layout.of(text_)).lists[name]


def test_a_rating_alone_changes_only_its_digits():
    plain = sidecar()
    assert xmp.edit_text(plain, "keep", "keep", [], []) == (plain, 3, False)
    assert xmp.edit_text(plain, "set:3", "keep", [], [])[0] == plain
    assert xmp.edit_text(plain, "set:-1", "keep", [], [])[0] == plain.replace('"3"', '"-1"')
    assert xmp.edit_text(plain, "restore:2:5", "keep", [], [])[0] == plain


def test_lists_come_with_their_name_space_and_go_without_a_trace():
    plain = sidecar()
    lit = xmp.edit_text(plain, "keep", "set", [], [])[0]
    assert listed(lit, xmp.LABELS) == ("2",) and lit.count("xmlns:darktable=") == 1 and "    keep  this\n" in lit
    dark, rating, green = xmp.edit_text(lit, "keep", "restore:0", [], [])
    assert (rating, green) == (3, True)
    assert dark == plain.replace("rdf:Description rdf:about", 'rdf:Description\n    xmlns:darktable="http://darktable.sf.net/" rdf:about')


def test_levels_of_tags_go_only_with_their_last_tag():
    text_, *_ = xmp.edit_text(sidecar(), "keep", "keep", ["a|b", "a|c", "d"], [])
    assert listed(text_, xmp.SUBJECT) == ("a", "b", "c", "d")
    text_, *_ = xmp.edit_text(text_, "keep", "keep", ["a|e"], ["a|b", "d"])
    assert listed(text_, xmp.HIERARCHY) == ("a|c", "a|e") and listed(text_, xmp.SUBJECT) == ("a", "c", "e")
    text_, *_ = xmp.edit_text(text_, "keep", "keep", [], ["a|c", "a|e"])
    assert text_.count("<rdf:li>") == 0 and "dc:subject>" not in text_


def test_blank_sidecars_and_refusals(spark):
    new, rating, green = xmp.edit_text(xmp.blank("x<y>.CR3"), "set:4", "set", ["t|u"], [], 2)
    at = xmp.Layout.of(new)
    assert (rating, green) == (2, False) and 'DerivedFrom="x&lt;y&gt;.CR3"' in new and xmp.State.of(new, at).rating == 4 and listed(new, xmp.SUBJECT) == ("t", "u")
    alone = '<rdf:Description rdf:about="" xmp:Rating="2"/>'
    assert xmp.edit_text(alone, "keep", "keep", [], [])[0] == alone
    opened = xmp.edit_text(alone, "set:1", "set", [], [])[0]
    assert xmp.State.of(opened, xmp.Layout.of(opened)).rating == 1 and listed(opened, xmp.LABELS) == ("2",) and opened.endswith("\n  </rdf:Description>")
    bad = ["", sidecar() * 2, sidecar(attrs="\n   xmp:Rating='3'"), sidecar("<xmp:Rating>3</xmp:Rating>\n", ""), sidecar("   <dc:subject>\n   <rdf:li lang='x'>a</rdf:li></dc:subject>\n"), sidecar("   <dc:subject>\n"), sidecar(attrs='\n   xmp:Rating="many"'), "<rdf:Description >"]
    d = spark.createDataFrame([(str(i), t, "set:1", "keep", ["new"], []) for i, t in enumerate(bad)] + [("tag", sidecar(), "keep", "keep", ["a<b"], [])], "file string, text string, rating string, green string, add array<string>, remove array<string>")
    got = d.select("text", xmp.edit_sidecars()(*d.columns).alias("e")).collect()
    assert all(r.e.error and r.e.text == r.text for r in got)


# ---- sending ----------------------------------------------------------------------------------------------------


def judged_frames(spark, rows):
    return spark.createDataFrame([("f", f, d, ["smile"] if d == "pick" else ["soft-eyes"]) for f, d in rows], "folder string, file string, decided string, reasons array<string>")


def test_changes_are_sent_confirmed_and_taken_back(spark, tmp_path):
    none = spark.createDataFrame([], "folder string, file string, rating_set int, rating_before int, green_before boolean, tags array<string>")
    known = spark.createDataFrame([("f", "q1"), ("f", "q2")], "folder string, file string")
    texts = spark.createDataFrame([("f", "s1", sidecar()), ("f", "s2", "broken")], "folder string, file string, text string")
    frames = judged_frames(spark, [("q1", "pick"), ("q2", "reject"), ("s1", "reject"), ("s2", "reject"), ("s3", "pick"), ("idle", None)])
    queue, side, receipts = (f"{tmp_path}/{x}" for x in ("queue", "side", "done"))
    report, sent = flows.send(spark, frames, none, known, texts, queue, side)
    assert [tuple(r) for r in report.collect()] == [("f", 2, 2, 1, 0)]
    written = {r.file: r.text for r in editor.read_sidecars(spark, side).collect()}
    assert written.keys() == {"s1", "s3"} and written["s1"].startswith(sidecar().split("note")[0][:40]) and listed(written["s3"], xmp.LABELS) == ("2",)
    assert xmp.State.of(written["s1"], xmp.Layout.of(written["s1"])).rating == -1
    assert {r[0] for r in state_of_sent(sent)} == {"s1", "s3"}

    images = spark.createDataFrame([("f", "q1", 0, False, 0), ("f", "q2", 5, False, 0)], "folder string, file string, rating int, green boolean, duplicate int")
    os.rename(queue, queue + ".applying")  # as if the editor had stopped halfway
    assert editor.apply_queues(spark, queue, receipts, lambda c: export.apply_changes(images, c)) == 1
    assert editor.apply_queues(spark, queue, receipts, lambda c: export.apply_changes(images, c)) == 0
    kept = []
    assert editor.consume_receipts(spark, receipts, lambda r: kept.append(export.record(sent, editor.parse_receipts(r).where("valid and status = 'ok'")).collect()))
    assert not editor.consume_receipts(spark, receipts, lambda r: kept.append(None))
    now = spark.createDataFrame(kept[0], none.schema)
    assert [r[:3] for r in state_of_sent(now) if r[0] == "q2"] == [("q2", -1, 5)]

    back = judged_frames(spark, [(f, None) for f in ("q1", "q2", "s1", "s2", "s3", "idle")])
    texts = editor.read_sidecars(spark, side)
    report, sent = flows.send(spark, back, now, known, spark.createDataFrame(texts.collect(), texts.schema), queue, side)
    text_ = {r.file: r.text for r in editor.read_sidecars(spark, side).collect()}["s1"]
    assert xmp.State.of(text_, xmp.Layout.of(text_)).rating == 3 and listed(text_, xmp.HIERARCHY) == ()
    assert {r[0] for r in state_of_sent(sent)} == {"q1", "q2"}

    withdrawn = sent.where("false")
    flows.send(spark, back, withdrawn, known, texts.limit(0), queue, side)
    assert not [n for n in os.listdir(queue) if n.startswith("name=")]


def test_an_editors_places_and_settings(spark, tmp_path):
    at = editor.locations("/h", cache_home="/c")
    assert at == {"library": "/h/.config/darktable/library.db", "settings": "/h/.config/darktable/darktablerc", "queue": "/c/shotplane/darktable"}
    (tmp_path / "darktablerc").write_text("a=1\nui_last/import_initial_rating= 3\n")
    assert editor.read_settings(spark, f"{tmp_path}/darktablerc") == 3 and editor.read_settings(spark, f"{tmp_path}/none") == 1


def test_components_by_rounds_equal_those_of_one_task(spark, monkeypatch):
    r = random.Random(7)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, 1000 + k) for k in range(1, 60)] + [(k, k + 1) for k in range(2000, 2040)]
    d = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    one = {tuple(x) for x in graph.components(d).collect()}
    monkeypatch.setattr(graph, "FEW", 0)
    assert {tuple(x) for x in graph.components(d).collect()} == one
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert one == {(a, c) for a, c in root.items() if any(a in p and p[0] != p[1] for p in links)}
    assert graph.components(d.limit(0)).count() == 0


def test_rolls_are_known_by_their_canonical_folder(spark):
    rolls = spark.createDataFrame([(1, "/p//one/./"), (2, "/p/two")], "id long, roll string")
    imgs = spark.createDataFrame([(1, "a"), (2, "b")], "film_id long, filename string")
    asked = spark.createDataFrame([("f", "/p/one"), ("g", "/p/./two/"), ("h", "/p/o")], "folder string, roll string")
    assert {(r.folder, r.file) for r in editor.imported(rolls, imgs, asked).collect()} == {("f", "a"), ("g", "b")}


def test_sessions_take_assignments_and_crops(spark):
    s = state.parse_sessions(spark.createDataFrame([("a", '{"people":{"x:0":7,"x:1":8},"splits":["q"]}')], "folder string, text string"))
    faces = spark.createDataFrame([("a", "x", 0, 9), ("a", "x", 1, None), ("b", "y", 2, 0)], "folder string, file string, face_idx int, person_id long")
    got = state.assign_faces(s, faces)
    assert {(r.folder, r.key, r.person_id) for r in state.overrides(got).collect()} == {("a", "x:0", 9), ("b", "y:2", 0)}
    assert state.edits(got, "splits").count() == 1
    crops_ = spark.createDataFrame([("a", "x", [((0.0, 0.0, 1.0, 0.5), (3, 2))])], "folder string, file string, crops array<struct<crop:struct<x:double,y:double,w:double,h:double>,ratio:struct<n:int,d:int>>>")
    once = state.set_crops(got, crops_)
    assert state.kept_crops(once).select("file", "rn").collect() == [("x", 3)]
    assert state.kept_crops(state.set_crops(once, crops_.withColumn("crops", F.col("crops").cast("array<struct<crop:struct<x:double,y:double,w:double,h:double>,ratio:struct<n:int,d:int>>>")).selectExpr("folder", "file", "slice(crops, 1, 0) as crops"))).count() == 0


def test_scenes_and_vectors_are_read_through_their_caches(spark):
    files = spark.createDataFrame([("f", "a", 1, 1), ("f", "b", 2, 2)], "folder string, file string, size long, mtime long")
    saved = files.where("file = 'a'").withColumn("made", F.lit("before")).unionByName(files.where("file = 'b'").withColumns({"mtime": F.lit(9).cast("long"), "made": F.lit("before")}))
    got = flows.scenes(saved, files, lambda d: d.withColumn("made", F.lit("anew")))
    assert {(r.file, r.made) for r in got.collect()} == {("a", "before"), ("b", "anew")}
    shots_ = spark.createDataFrame([("f", "a", True, [1]), ("f", "b", False, [1]), ("f", "c", False, [])], "folder string, file string, embedded boolean, faces array<int>")
    exif_ = spark.createDataFrame([("f", "b", 6), ("g", "b", 3)], "folder string, file string, orientation int")
    seen = flows.backfill(shots_, exif_, lambda d: d.withColumns({"embedded": F.lit(True), "faces": F.array("turned")}))
    assert {(r.file, r.embedded, tuple(r.faces)) for r in seen.collect()} == {("a", True, (1,)), ("b", True, (6,)), ("c", False, ())}


# ---- state, files, times ----------------------------------------------------------------------------------------


def test_old_and_broken_sessions_load(spark):
    d = spark.createDataFrame([("a", '{"decisions":{"x":{"mark":"pick","stars":3}},"unknown":[1]}'), ("b", "not json"), ("c", '{"sent":{"x":{"rating":{"set":-1,"before":2},"tags":["t"]}},"crops":{"x":[{"crop":{"x":0,"y":0,"w":1,"h":0.5},"ratio":{"n":3,"d":2}}]}}')], "folder string, text string")
    s = state.parse_sessions(d).cache()
    assert {(r.folder, r.file, r.mark, r.stars) for r in state.decisions(s).collect()} == {("a", "x", "pick", 3)}
    assert state_of_sent(state.sent(s)) == [("x", -1, 2, None, ("t",))]
    assert state.kept_crops(s).select("h", "rn").first() == (0.5, 3)
    assert state.edits(s, "splits").count() == state.overrides(s).count() == 0


def test_sessions_and_libraries_are_saved_and_read(spark, tmp_path):
    s = state.parse_sessions(spark.createDataFrame([("a", '{"splits":["q"],"people":{"x:0":7}}')], "folder string, text string"))
    state.save_sessions(s, f"{tmp_path}/s")
    files = [f"{tmp_path}/s/folder=a/{f}" for f in os.listdir(f"{tmp_path}/s/folder=a") if f.endswith(".txt")]
    back = state.parse_sessions(spark.createDataFrame([("a", open(files[0]).read())], "folder string, text string"))
    assert [tuple(r) for r in state.overrides(back).collect()] == [("a", "x:0", 7)] and state.edits(back, "splits").first()["file"] == "q"
    lib = state.parse_library(spark.createDataFrame([('{"people":[{"id":4,"name":"Z","samples":[[1,2]]},{"id":2,"name":"A"}]}',)], "text string"))
    assert [(r.id, r.name, r.pos, len(r.samples)) for r in lib.collect()] == [(4, "Z", 0, 1), (2, "A", 1, 0)]
    state.save_library(lib, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 2


def test_folders_are_listed_and_refreshed(spark, tmp_path):
    home = tmp_path / "photos"
    home.mkdir()
    for n in ("a.CR3", "a.jpg", "b.JPG", "c.txt", "d.jpeg", "D.cr2", "noext"):
        (home / n).write_bytes(b"x" * len(n))
    files = listing.list_folder(spark, str(home))
    assert {r.file for r in listing.photos(files).collect()} == {"a.CR3", "b.JPG", "d.jpeg", "D.cr2"}

    def analyse(f):
        return f.select(*listing.FINGERPRINT, F.lit(1).alias("version"), F.when(F.col("file") == "b.JPG", "broken").alias("error"), F.lit("new").alias("made"))

    first = flows.refresh(spark, str(home), None, analyse)
    listing.save(first.withColumn("made", F.lit("saved")), str(tmp_path / "cache"))
    (home / "a.CR3").write_bytes(b"longer")
    again = flows.refresh(spark, str(home), str(tmp_path / "cache"), analyse)
    assert {(r.file, r.made) for r in again.select("file", "made").collect()} == {("a.CR3", "new"), ("b.JPG", "new"), ("d.jpeg", "saved"), ("D.cr2", "saved")}


def test_exif_times(spark):
    d = spark.createDataFrame([("2024:02:28 23:59:59",), ("2024:03:01 00:00:00",), ("2000:01:01 00:00:00",), ("2024:01",), ("",), (None,)], "s string")
    t = [r.t for r in d.select(exif.parse_exif_time(F.col("s")).alias("t")).collect()]
    assert t[1] - t[0] == 86401 and t[3] is t[4] is t[5] is None
    assert t[2] == 946684800 + 719468 * 86400


def test_small_functions(spark):
    d = spark.createDataFrame([("a.b/IMG-1.x.CR3", [1.0, 2.0, 3.0])], "f string, v array<double>")
    c = F.col
    got = d.select(text.stem(text.file_name(c("f"))).alias("a"), text.short_name(text.file_name(c("f"))).alias("b"), text.extension(c("f")).alias("c"), vectors.dot(c("v"), F.slice("v", 1, 2)).alias("d"), vectors.percentile_by_index(c("v")).alias("e"), vectors.percentile_by_index(F.slice("v", 1, 0)).alias("g"), hashing.fnv1a_low32(F.lit("")).alias("h"), text.escape(F.lit('<a&"')).alias("i"), vectors.named(c("v"), ["x", "y"], "y").alias("j"), vectors.named(c("v"), ["x"], "q").alias("k"), text.lift(F.lit(None).cast("double")).alias("l")).first()
    assert tuple(got) == ("IMG-1.x", "1.x", "cr3", 5.0, 3.0, 0.0, 0x84222325, "&lt;a&amp;&quot;", 2.0, 0.0, 1.0)

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h % 2**32

    s = "päth/日本"
    assert spark.range(1).select(hashing.fnv1a_low32(F.lit(s)).alias("h")).first()["h"] == fnv(s.encode())
    box = (0.1, 0.2, 0.5, 0.25)
    assert spark.range(1).select(hashing.crop_id(*map(F.lit, box)).alias("h")).first()["h"] == f"{fnv(struct.pack('<4f', *box)):08x}"


# ---- detections, crops, kernels ---------------------------------------------------------------------------------


def iou(a, b):
    i = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0) * max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
    return i / (a[2] * a[3] + b[2] * b[3] - i)


def test_suppression_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(k % 4, k, *(float(r.randrange(0, 60)) for _ in range(2)), *(float(r.randrange(20, 60)) for _ in range(2)), r.randrange(10) / 10) for k in range(80)]
    got = {(x.image, x.id) for x in detect.suppress(spark.createDataFrame(rows, "image int, id int, x double, y double, w double, h double, score double")).collect()}
    want = set()
    for im in range(4):
        kept = []
        for row in sorted((x for x in rows if x[0] == im), key=lambda x: (-x[6], x[1])):
            if all(iou(row[2:6], k[2:6]) < DetectConfig().max_iou for k in kept):
                kept.append(row)
        want |= {(im, k[1]) for k in kept}
    assert got == want


def test_blur_lowers_sharpness_and_darkening_keeps_it():
    r = np.random.default_rng(5)
    v = (r.random((80, 120)) > 0.5) * 200.0
    blur = lambda x: (x + np.roll(x, 1, 0) + np.roll(x, 1, 1) + np.roll(x, -1, 0) + np.roll(x, -1, 1)) / 5
    a, b, c = image.np_sharpness(v), image.np_sharpness(blur(v)), image.np_sharpness(blur(blur(v)))
    assert a > b > c and abs(image.np_sharpness(v * 0.4) / a - 1) < 0.35
    assert image.np_sharpness(v[:4]) == 0


def test_array_kernels():
    v = np.arange(400.0).reshape(20, 20)
    assert image.np_fit(v, 40) is v and image.np_fit(v, 10).shape == (10, 10)
    assert abs(image.np_resize(v, 10, 10).mean() - v.mean()) < 1
    sig = image.np_signature(v)
    assert len(sig) == 256 and sig.min() == 0 and sig.max() == 255
    assert image.np_lift(v / 8).max() > (v / 8).max()
    p = np.array([[1.0, 2], [4, 3], [6, 8], [2, 7], [9, 1]])
    a, b, tx, ty = 1.5, 0.4, 3.0, -2.0
    q = np.column_stack([a * p[:, 0] - b * p[:, 1] + tx, b * p[:, 0] + a * p[:, 1] + ty])
    assert np.allclose(image.np_similarity(p, q), (a, b, tx, ty))
    assert np.allclose(image.np_align(v, p, p, 10), v[:10, :10])
    assert np.allclose(image.np_warp(v, 10, 10, 20, 0.0, 20), v)


class Fake(image.Models):
    def detect(self, pixels):
        return [{"bbox": [0, 0, 10, 10]}, {"bbox": [5, 5, 2, 2]}, {"bbox": [0, 0, 20, 9]}]

    def embed(self, pixels, detection):
        return [float(detection["bbox"][2])], 10.0


def decode(data):
    if data == b"bad":
        raise ValueError("no image")
    return np.frombuffer(data, np.uint8).reshape(20, 20).astype(float)


def test_tiles_and_crops_of_pixels(spark):
    r = np.random.default_rng(12)
    v = np.round(r.random((48, 64)) * 255)
    v[:24, :32] = 40.0
    got = image.np_tiles(v, 8)
    assert got["sharp"].shape == (6, 8)
    half, quarter = (np.round(image.np_resize(v, 48 // k, 64 // k)) for k in (2, 4))
    for row, col in ((0, 0), (5, 7), (2, 5)):
        t = half[row * 4 : row * 4 + 4, col * 4 : col * 4 + 4]
        assert got["luma"][row, col] == pytest.approx(t.mean() / 255)
        total = 0
        for y in (2 * row, 2 * row + 1):
            for x in (2 * col, 2 * col + 1):
                at = lambda j, i: quarter[min(max(j, 0), 11), min(max(i, 0), 15)]
                total += min((abs(at(y, x + 1) - at(y, x - 1)) + abs(at(y + 1, x) - at(y - 1, x))) // 2, 255)
        assert got["edge"][row, col] == pytest.approx(total / 4 / 255)
    assert got["sharp"][0, 0] == 0 and image.np_tiles(v, 2)["sharp"][1, 1] > 0
    d = spark.createDataFrame([(48, 64, v.ravel().tolist())], "h int, w int, v array<double>").select(image.tiles_column(F.col("h"), F.col("w"), F.col("v"), 8).alias("t")).first().t
    assert (d.cols, d.rows) == (8, 6) and d.luma == pytest.approx(got["luma"].ravel().tolist())
    crop = image.np_grey_crop(v, (-5.0, 10.0, 25.0, 100.0), 0.5)
    assert crop.shape == (19, 10) and image.np_grey_crop(v, (60.0, 40.0, 30.0, 30.0), 3.0).shape == (8, 4)
    colour = np.zeros((4, 4, 3))
    colour[..., 1] = 100
    assert (image.np_grey(colour) == 72).all()


def test_a_failed_file_is_a_row(spark):
    d = spark.createDataFrame([("f", "a", bytes(range(200)) * 2), ("f", "b", b"bad")], "folder string, file string, content binary")
    got = {r.file: r for r in image.analyse(d, Fake, decode).collect()}
    assert got["a"].n_faces == 2 and got["a"].embeds == [[20.0], [10.0]] and got["a"].error is None
    assert got["b"].error.startswith("ValueError") and got["b"].width == 0 and not got["b"].sig


def test_sessions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    from shotplane.streaming.sessions import gap_sessions

    rows = pd.DataFrame({"folder": ["a"] * 4 + ["b"], "ts": pd.to_datetime([0, 30, 200, 100000, 5], unit="s"), "value": [1.0, 5, 2, 1, 9]})
    d = spark.createDataFrame(rows)
    d.write.parquet(f"{tmp_path}/in")
    q = gap_sessions(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), late="1 second").writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("gaps").collect()}
    assert got and got <= {tuple(r) for r in gap_sessions(d).collect()} and len(got) == 3


def test_flow_from_frames_to_changes(spark):
    d = shots(spark, [frame("a", 0, [face()]), frame("b", 1, [face(sharp=3.0)]), frame("c", 2, [face(blink=(0.9, 0.9))])])
    s = state.parse_sessions(spark.createDataFrame([("f", '{"decisions":{"a":{"mark":"pick"},"c":{"mark":"reject"},"b":{"mark":"none"}}}')], "folder string, text string"))
    j = flows.judged(d, s).cache()
    assert {r.file: r.effective for r in j.collect()} == {"a": "pick", "b": "none", "c": "reject"}
    got = {(r.file, r.rating, r.green, r.route) for r in flows.changes(j, s, spark.createDataFrame([("f", "c")], "folder string, file string")).collect()}
    assert got == {("a", "keep", "set", "sidecar"), ("c", "set:-1", "keep", "queue")}
    assert {r.file for r in view.tiles(j.withColumn("persons", F.array(F.lit(1))), "rejected").collect()} == {"c"}
    assert len(schema.FACE) == 16
