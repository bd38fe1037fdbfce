"""Parts of credentials of any length are found, linked and redacted whole."""

import random
import re

from shotplane.llm import secrets
from tests_llm_helpers import linked_spans

KEY = "aB3" * 12
LONG_URL = "https://h.example.net/" + "p/" * 200
LONG_KEY = "aB3" * 60
CASES = [
    LONG_URL + " q " + KEY,
    "12@a.example.com " + LONG_KEY,
    "https://h.example.net/" + "p" * 700 + " password=hunter22",
    "user: " + "j" * 300 + " password=hunter22",
    LONG_URL + " " * 256 + KEY,
    LONG_URL + " " * 257 + KEY,
    KEY + " " * 256 + LONG_URL,
    KEY + " " * 257 + LONG_URL,
]


def test_long_parts_are_linked_and_redacted_whole(spark):
    r = random.Random(3)
    bits = ["token=abcdefg", " ", "12@a.b.com", KEY, LONG_KEY, LONG_URL, "https://h.example.net/q", "user: joe", "x" * 90 + " ", "𝒳 ", "z " * 100, " "]
    texts = CASES + ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(2, 30))) for _ in range(80)]
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.kind, s.end) for s in x.found] for x in secrets.scan_secrets(d).collect()}
    for i, t in rows:
        assert got[i] == [(a, k, b) for a, _, k, b in linked_spans(t)], t
    assert [len(got[i]) for i in range(len(CASES))] == [2, 2, 2, 2, 2, 0, 2, 0]
    clean = {x.doc_id: x.text for x in secrets.redact(d.where(f"doc_id < {len(CASES)}")).collect()}
    assert clean[0] == "[SECRET] q [SECRET]" and clean[1] == clean[2] == clean[3] == "[SECRET] [SECRET]"


def test_long_runs_take_linear_time(spark):
    texts = ["aB3+" * 250_000, "a@" * 300_000, "a@b" + ".c" * 300_000 + "!", "login:" * 100_000, "a." * 300_000, "https://" * 60_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secrets.scan_secrets(d).count() == len(texts)


def test_many_secrets_in_a_long_text_are_redacted(spark):
    r = random.Random(5)
    text = "".join(f"{'é𝒳x '[r.randrange(4)] * r.randrange(40)} token=abc{i:07d} " for i in range(20_000)) + "z" * 40_000
    d = spark.createDataFrame([(1, text), (2, "password: secret: token=abcdef1234 x")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in secrets.redact(d).collect()}
    for i, t in ((1, text), (2, "password: secret: token=abcdef1234 x")):
        at, out = 0, []
        for a, _, _, b in linked_spans(t) if i == 2 else [(m.start(), 0, 0, m.end()) for m in re.finditer(r"token=abc\d{7}", t)]:
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert got[i] == "".join(out) + t[at:]
