"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotplane.llm.common import cut, key_filter, passing, unused

#: Base patterns and the least length of what they must hold (fixed values of the contract).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The other two with their least lengths, 20 and 24: a match of `AKIA[A-Z0-9]+` or `[0-9a-f]+` is the longest run from its
#: start, and no later start in a run that is too short could be longer.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Weak parts: names of accounts, opaque keys, and places where credentials are used. None has a greatest length;
#: possessive quantifiers keep them linear.
IDENT = r"""(?<![A-Za-z0-9._+-])(?:(?i:client_id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}+|[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"""
KEY = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]{2,16}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]{4,}+"""
#: All kinds in their order, and what each is a part of.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "key": "secret", "endpoint": "endpoint"}
#: Weak kinds and the parts that complete them.
COMPLEMENTS = {"ident": ["secret"], "key": ["identifier", "endpoint"], "endpoint": ["secret"]}
#: Code points between two parts of one credential.
SCOPE = 256
#: Numbers that a prefix sum adds at once, and code points of a block from which pieces of a text are taken.
STRIDE, BLOCK = 256, 1 << 13


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, join: Callable[[Column, Column], Column] = lambda s, x: s + x) -> Column:
    """Inclusive prefix sums (or greatest values) of an array of longs from 0 on, over blocks, so that long arrays cost little
    more than their length."""
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, join)

    def body(q: Column) -> Column:
        last = F.floor((F.size(q) - 1) / STRIDE).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(q, b * STRIDE + 1, STRIDE)))
        return let(let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b)))), lambda p: F.transform(q, lambda _, i: join(F.get(p, F.floor(i / STRIDE).cast("int")), total(F.slice(q, F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE + 1)))))

    return F.when(F.size(numbers) > 0, let(numbers, body)).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end) in code points, end exclusive; keep tests a match's own text.

    Texts are cut at the matches: the pieces between them and the matches themselves give all places.
    """

    def body(pieces: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m: F.char_length(m).cast("long"))
        steps = F.transform(found, lambda m, i: F.char_length(F.get(pieces, i)).cast("long") + F.when(i > 0, F.char_length(F.get(found, i - 1)).cast("long")).otherwise(F.lit(0).cast("long")))
        all_spans = let(lengths, lambda n: let(running(steps), lambda p: F.transform(found, lambda m, i: F.struct(F.get(p, i).alias("start"), (F.get(p, i) + F.get(n, i)).alias("end"), m.alias("m")))))
        kept = F.filter(all_spans, lambda s: keep(s["m"])) if keep else all_spans
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    some = let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: body(pieces, found)))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def blanked(text: Column, pattern: str) -> Column:
    """The text with every match replaced by as many control characters."""
    whole = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.concat(p, F.coalesce(F.repeat(F.lit("\x01"), F.char_length(m)), F.lit("")))), ""))
    return F.when(text.rlike(pattern), whole).otherwise(text)


def without(text: Column, pattern: str) -> Column:
    return let(text, lambda t: blanked(t, pattern))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": spans(text, ASSIGN, lambda m: F.char_length(F.regexp_replace(m, "^" + ASSIGN + "$", "$2")) >= ASSIGN_LEAST),
        "access": spans(text, ACCESS),
        "hex": spans(text, HEX),
    }


def _label(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"], s["end"])


def _named(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Finds secrets in every whole text and links parts of one credential.

    Returns a row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked and found, the
    spans as an array of (start, rank, kind, end), and _h, a hash of the text. Null texts count as empty. Rows that repeat an id with another text
    are told apart by a hash of the text; equal rows get equal results. Null ids pass through, other columns are left
    out.

    Base kinds are found as they are. Weak parts (account names, opaque keys, endpoints) are looked for beside them, in
    the text without base matches. A weak part is reported only if at most `scope` code points lie between it and a part
    that completes it in the same document, from the end of one to the start of the other. That interval join is an equal join on bins of that width, which a part has
    from its start to that end, against each bin's first start and last end by part, so no pairs of a crowded text are
    made: two parts of one bin lie less than its width apart, so one of them is near wherever both together seem so.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    weak_text = F.when(F.col("text").rlike("@|://|" + KEY + "|(?i:client_id|user|login|account)"), F.col("text")).otherwise(F.lit(""))
    for p in (ASSIGN, ACCESS, HEX):
        weak_text = without(weak_text, p)
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    d = d.select("doc_id", F.xxhash64("text").alias("h"), *(c.alias(k) for k, c in base_spans(F.col("text")).items()), weak_text.alias("weak"))
    d = d.select("doc_id", "h", "assign", "access", "hex", spans(F.col("weak"), IDENT).alias("ident"), spans(F.col("weak"), KEY, mixed).alias("key"), spans(F.col("weak"), ENDPOINT).alias("endpoint"))
    rows, _ = cut(d, "parts")

    every = F.concat(*(_named(k, F.col(k)) for k in KINDS))
    role = F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v))), F.col("p.kind"))
    needy = rows.where(" or ".join(f"size({k}) > 0" for k in COMPLEMENTS))
    parts = needy.select("doc_id", "h", F.explode(every).alias("p")).select("doc_id", "h", "p", role.alias("role"), F.col("p.start").alias("from"), F.col("p.end").alias("to")).withColumns({"first": F.floor(F.col("from") / scope).cast("long"), "last": F.floor(F.col("to") / scope).cast("long")})
    held = parts.select("doc_id", "h", "role", "from", "to", F.explode(F.sequence("first", "last")).alias("bin"))
    bins = held.groupBy("doc_id", "h", "bin", "role").agg(F.min("from").alias("lo"), F.max("to").alias("hi")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("bin").alias("at"), F.col("role").alias("other"), "lo", "hi")
    wants = F.create_map(*(x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    weak = parts.where(F.col("p.kind").isin(*COMPLEMENTS)).select("doc_id", "h", "p", "from", "to", "first", "last", F.explode(F.element_at(wants, F.col("p.kind"))).alias("want")).select("doc_id", "h", "p", "from", "to", "want", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("near"))
    met = weak.join(bins, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("near") == F.col("at")) & (F.col("want") == F.col("other")))
    linked = met.where((F.col("lo") <= F.col("to") + scope) & (F.col("hi") >= F.col("from") - scope)).groupBy("doc_id", "h").agg(F.collect_set("p").alias("linked")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "linked")

    base = F.array_sort(F.concat(*(_named(k, F.col(k)) for k in ("assign", "access", "hex"))))
    out = rows.select("doc_id", "h", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), base.alias("base")).join(linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    found = F.array_sort(F.concat("base", F.coalesce("linked", none)))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join(F.transform("base", _label), ",").cast("binary"), 256).alias("base_sha256"), found.alias("found"), "h", F.size(F.coalesce("linked", none)).cast("long").alias("n_linked")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform("found", _label), ",").alias("spans"), "n_linked", "found", F.col("h").alias("_h"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The documents with all spans that scan_secrets finds replaced by a mark, n_chars following where it is there.

    Spans that overlap get one mark. All rows and columns stay; texts without a span, and null texts, stay as they are:
    rows whose id has no span (by a filter of such ids) are not moved. The others meet their spans by id and a hash of the
    text. Texts are cut into blocks once and pieces taken from these, so the time grows with a text's length, whatever the
    number of its spans.
    """
    i, h, own, hit, clean = unused(docs, "_id", "_hash", "_own", "_hit", "_clean")
    found, _ = cut(scan_secrets(docs, scope).where("size(found) > 0").select("doc_id", "_h", "found").distinct(), "found")
    words, _ = cut(key_filter(found.select(F.xxhash64("doc_id").alias("h"))), "owners")
    near = passing(docs, F.xxhash64("doc_id"), words).withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    spans_of = found.select(F.col("doc_id").alias(i), F.col("_h").alias(h), F.col("found").alias(hit))
    marked = near.join(spans_of, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), "left")
    some = F.col(hit).isNotNull()
    out = marked.withColumn(clean, F.when(some, replaced(F.col("text"), F.col(hit), mark)).otherwise(F.col("text"))).withColumn("text", F.col(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return passing(docs, F.xxhash64("doc_id"), words, inside=False).unionByName(out.select(*docs.columns))


def replaced(text: Column, found: Column, mark: str) -> Column:
    """A text with spans, sorted by their start, replaced by marks; overlapping spans get one."""

    def pieces(blocks: Column, reach: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            ks = F.sequence(F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int"))
            part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * BLOCK, F.lit(0)).cast("int") + 1, (F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0))).cast("int"))
            return F.array_join(F.transform(ks, part), "")

        before = lambda k: F.when(k > 0, F.get(reach, k - 1)).otherwise(F.lit(0).cast("long"))
        body = F.transform(found, lambda s, k: F.when(s["start"] >= before(k), F.concat(between(before(k), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(body, ""), between(F.element_at(reach, -1), F.char_length(text).cast("long")))

    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / BLOCK).cast("int")), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK)))
    return let(cuts, lambda blocks: let(running(F.transform(found, lambda s: s["end"]), lambda s, x: F.greatest(s, x)), lambda reach: pieces(blocks, reach)))
