import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from shotplane.llm import dedup_exact


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    """(id, keep_id, size, sha) of each row; and how many rows of each text are kept: one."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    best = {n: min(g, key=lambda x: x[:3])[3] for n, g in groups.items()}
    return sorted((str(i), str(best[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


ROWS = [(5, "a b c"), (1, "abc"), (2, "a\tb\nc"), (3, None), (4, ""), (6, " \r\x0b\x0c"), (7, "a b"), (8, "ab"), (1, "abc"), (None, "zz"), (9, "z z"), (10, "é" * 5), (11, "long " * 3000), (12, "long" * 3000)]
#: An id that has the shorter and the longer text, and rows that tie in length and id.
REPEATED = [(1, "abc"), (1, "a b c"), (2, "ab c"), (7, "x y"), (7, "x y"), (7, "xy "), (8, "xy"), (None, "q"), (None, "q")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "q", True) for i, t in rows], "doc_id long, text string, group_size int, digest string, kept boolean")


def check(got, rows):
    got = got.collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == dict.fromkeys({r.text_sha256 for r in got}, 1)
    assert all(str(r.doc_id) == str(r.keep_id) for r in got if r.kept)


def test_equals_brute_force(spark):
    for rows in (ROWS, REPEATED, []):
        check(dedup_exact.exact_duplicates(frame(spark, rows)), rows)


def test_many_runs_are_merged_in_rounds(spark):
    rows = [(i, f"{'w ' * (i % 7)}text {i % 60}") for i in range(400)] + ROWS + REPEATED
    index = dedup_exact.DigestIndex(spark, fan_in=2)
    check(dedup_exact.exact_duplicates(frame(spark, rows).repartition(11), index), rows)
    assert index.runs == 11 and index.rounds == [6, 3, 2, 1]
    per_run = index.rows().groupBy("run").agg(F.collect_list("digest").alias("d")).collect()
    assert len(per_run) == 11 and all(r.d == sorted(r.d) for r in per_run)


def test_a_later_flush_joins_the_earlier_runs(spark):
    index = dedup_exact.DigestIndex(spark)
    index.flush(frame(spark, ROWS))
    before = index.runs
    check(dedup_exact.exact_duplicates(frame(spark, REPEATED), index), ROWS + REPEATED)
    assert index.runs > before


def test_unique_digests_pass_no_filter(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(900, "text 5"), (901, "text 6")]
    index = dedup_exact.DigestIndex(spark)
    check(dedup_exact.exact_duplicates(frame(spark, rows), index), rows)
    held = dedup_exact.passing(index.rows(), F.xxhash64("digest"), index.filter())
    assert 4 <= held.count() <= 8


def test_collided_digests_are_told_apart_by_their_bytes(spark):
    rows = ROWS + REPEATED
    index = dedup_exact.DigestIndex(spark, digest=lambda n: F.char_length(n).cast("string"))
    check(dedup_exact.exact_duplicates(frame(spark, rows), index), rows)


def test_one_row_of_each_group_stays(spark):
    for rows in (ROWS, REPEATED, ROWS + REPEATED, []):
        d = frame(spark, rows).selectExpr("*", "1 as _id", "'x' as _key", "2 as _best", "map(1, 2) as m")
        kept = dedup_exact.drop_duplicates(d)
        assert kept.columns == d.columns
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert sorted(norm(t) for _, t in got) == sorted({norm(t) for _, t in rows})
        best = {x[3]: x[1] for x in brute(rows)}
        for i, t in got:
            sha = hashlib.sha256(norm(t).encode()).hexdigest()
            assert str(i) == best[sha] and len(t or "") == max(len(u or "") for _, u in rows if norm(u) == norm(t))
