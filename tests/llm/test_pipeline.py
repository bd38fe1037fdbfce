import random
import re

import corpus_pipeline
from shotplane.llm import packing, token_counts, toxicity
from tests_llm_helpers import components, linked_spans, shingles


def rows():
    r = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    out = []
    for i in range(160):
        n = r.choice([3, 12, 60, 200])
        out.append(" ".join(r.choice(words) for _ in range(n)))
    for i in range(0, 30):
        w = out[i].split()
        if len(w) >= 60:
            w[7] = "edited"
        out.append(" ".join(w) + ("  " if i % 2 else ""))
    for i in range(60):
        out.append(" ".join([*(r.choice(words) for _ in range(20)), "grunk", *(r.choice(words) for _ in range(9))]))
    out += [f"{' '.join(r.choice(words) for _ in range(15))} token = \"{i:040x}\" end 1{i}@mail.example.com" for i in range(10)]
    out += ["", None, " ", None]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(out)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int("grunk" in (t or ""))) for i, t, *_ in data if i % 3], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model, _ = toxicity.learn(docs, labels)
    marker = toxicity.Marker(model.entries)
    left = {i: t for i, t, *_ in data if model.score(marker.of(t or "")) < 0.5}
    assert set(left) == {i for i, t, *_ in data if "grunk" not in (t or "")}
    best = {}
    for i, t in sorted(left.items()):
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        if n not in best or len(t or "") > len(left[best[n]] or ""):
            best[n] = i
    left = {i: left[i] for i in best.values()}
    sets = {i: shingles(t) for i, t in left.items()}
    ids = sorted(sets)
    comp = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    left = {i: t for i, t in left.items() if comp[i] == i}
    tok = token_counts.load(token_counts.tokenizer_path())
    want = []
    for i, t in left.items():
        text, at, out = t or "", 0, ""
        for a, _, _, b in linked_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        n = len(tok.encode(out + text[at:], add_special_tokens=False).ids) + 1
        want += [(i, k, a, m) for k, (a, m) in enumerate(packing.cut_pieces(n))]
    assert sorted((x.doc_id, x.piece, x.start, x.length) for x in got) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(rows()[:0], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Rows that share an id, repeated rows, null ids, and columns named as the stages' own."""
    long = " ".join(f"w{i}" for i in range(40))
    data = [(1, "abc def"), (1, "abc  def"), (2, "abcdef"), (3, long), (3, long), (4, long + " more"), (5, None), (None, "no id"), (None, "no id"), (6, "key token=abcdef1234 end"), (6, "other token=zzzzzz1 end")]
    extra = "array(1) as bands, 'q' as _id, 2 as _key, 'x' as found, map('a', 1) as m, 3 as fill, 4 as rep, 5 as node, true as kept, 'h' as _h"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", extra.split(" as ")[0] + " as bands", *[e.strip() for e in extra.split(",") if " as " in e and "bands" not in e and "map" not in e and e.strip() != "1) as m"], "map('a', 1) as m")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted((str(r.doc_id), r.text or "") for r in now.collect()))
    assert len(kept[0]) == len(data)
    copies = [("1", "abc  def"), ("3", long), ("4", long + " more"), ("5", ""), ("6", "key token=abcdef1234 end"), ("6", "other token=zzzzzz1 end"), ("None", "no id")]
    assert kept[1] == copies
    assert kept[2] == [x for x in copies if x[0] != "4"]
    assert [t for i, t in kept[3] if i == "6"] == ["key [SECRET] end", "other [SECRET] end"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[3])
