"""Layout-preserving edits of sidecar markup.

Columns read it; edits, which must keep every other byte, run in a pandas function over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shotplane.functions.text import attribute

#: Lists in a sidecar and their containers, and name spaces (fixed values of the format).
LABELS, SUBJECT, HIERARCHY = "darktable:colorlabels", "dc:subject", "lr:hierarchicalSubject"
CONTAINER = {LABELS: "rdf:Seq", SUBJECT: "rdf:Bag", HIERARCHY: "rdf:Bag"}
NAMESPACES = {
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "darktable": "http://darktable.sf.net/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "lr": "http://ns.adobe.com/lightroom/1.0/",
}
OPEN, CLOSE, RATING = "<rdf:Description", "</rdf:Description>", "xmp:Rating"
#: The label of the colour green.
GREEN = "2"
#: What a sidecar is cut into: the description's start tag (quoted values may hold anything), its lists, its end.
START = re.compile(OPEN + r"""(?P<inside>(?:"[^"]*"|'[^']*'|[^"'>])*?)(?P<alone>/?)>""")
ITEM = re.compile(r"<rdf:li>(.*?)</rdf:li>", re.S)
#: A file that the editor has not seen (fixed text of the format).
BLANK = """<?xml version="1.0" encoding="UTF-8"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{toolkit}">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description rdf:about=""
    xmlns:xmpMM="http://ns.adobe.com/xap/1.0/mm/"{spaces}
   xmpMM:DerivedFrom="{image}">
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
"""


class SidecarError(ValueError):
    """A sidecar whose layout is not known; it is left alone."""


def need(fine: object, why: str) -> None:
    if not fine:
        raise SidecarError(why)


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def blank(image: str, toolkit: str = "cull") -> str:
    return BLANK.format(toolkit=toolkit, image=escape(image), spaces="".join(f'\n    xmlns:{p}="{u}"' for p, u in NAMESPACES.items()))


@dataclass(frozen=True)
class Layout:
    """Where the parts of a sidecar stand: spans of its text, found in one reading. Nothing is changed here."""

    tag: tuple[int, int]  # what stands in the start tag, after its name
    alone: bool  # the tag ends the description, too
    rating: tuple[int, int] | None
    lists: dict[str, tuple[int, int]]  # from the start of the line that opens a list to its end
    close: int  # the end tag; the start tag's end where that is alone

    @classmethod
    def of(cls, text: str) -> Layout:
        tags = [m for m in re.finditer(OPEN, text)]
        need(len(tags) == 1, "there must be one description, and only one")
        start = START.match(text, tags[0].start())
        need(start, "the description's tag has no end")
        alone = bool(start["alone"])
        ends = [m.start() for m in re.finditer(CLOSE, text)]
        need(len(ends) == (0 if alone else 1), "the description must be closed once")
        close = start.end() if alone else ends[0]
        value = re.search(rf"\s{RATING}=(?:\"([^\"]*)\"|(.))", start["inside"])
        need(value or f"<{RATING}>" not in text, "a rating that is an element cannot be edited")
        need(not value or value[1] is not None, "a rating must stand in double quotes")
        shift = start.start("inside")
        rating = (shift + value.start(1), shift + value.end(1)) if value else None
        return cls(start.span("inside"), alone, rating, {name: span for name in CONTAINER if (span := cls._list(text, name, start.end(), close))}, close)

    @staticmethod
    def _list(text: str, name: str, lo: int, hi: int) -> tuple[int, int] | None:
        found = re.compile(rf"<{name}(/?)>").search(text, lo, hi)
        if not found:
            return None
        end = found.end() if found[1] else text.find(f"</{name}>", found.end(), hi) + len(f"</{name}>")
        need(end > found.start(), f"{name} has no end")
        line = text.rfind("\n", 0, found.start()) + 1
        need(not text[line : found.start()].strip(), f"{name} shares its first line")
        return line, end


@dataclass(frozen=True)
class State:
    """What a change reads and writes of a sidecar: its rating and its lists."""

    rating: int | None
    lists: dict[str, tuple[str, ...]]

    @classmethod
    def of(cls, text: str, at: Layout) -> State:
        lists = {}
        for name in CONTAINER:
            body = text[slice(*at.lists[name])] if name in at.lists else ""
            lists[name] = tuple(ITEM.findall(body))
            need(len(lists[name]) == body.count("<rdf:li"), f"{name} has items that cannot be kept")
        number = text[slice(*at.rating)].strip() if at.rating else None
        need(number is None or re.fullmatch(r"[+-]?\d+", number), "the rating is no number")
        return cls(None if number is None else int(number), lists)


def rewritten(text: str, at: Layout, old: State, new: State) -> str:
    """The text with what differs between two states put in its place, all at once; every other byte stays."""
    puts: list[tuple[int, int, str]] = []
    spaces, blocks, attributes = [], [], ""
    if new.rating != old.rating:
        if at.rating:
            puts.append((*at.rating, str(new.rating)))
        else:
            attributes = f'\n   {RATING}="{new.rating}"'
            spaces.append("xmp")
    for name, items in new.lists.items():
        if items == old.lists[name]:
            continue
        box = CONTAINER[name]
        lines = [f"   <{name}>", f"    <{box}>", *(f"     <rdf:li>{i}</rdf:li>" for i in items), f"    </{box}>", f"   </{name}>"]
        if name in at.lists:
            lo, hi = at.lists[name]
            puts.append((lo, hi, "\n".join(lines)) if items else (max(lo - 1, 0), hi, ""))
        elif items:
            spaces.append(name.partition(":")[0])
            blocks.append("\n" + "\n".join(lines))
    missing = [p for p in dict.fromkeys(spaces) if f"xmlns:{p}=" not in text]
    lo, hi = at.tag
    puts.append((lo, lo, "".join(f'\n    xmlns:{p}="{NAMESPACES[p]}"' for p in missing)))
    if at.alone and (blocks or attributes or puts[:-1]):
        puts.append((hi, hi + 2, f"{attributes}>{''.join(blocks)}\n  {CLOSE}"))
    else:
        puts.append((hi, hi, attributes))
        if blocks:
            line = text.rfind("\n", 0, at.close)
            need(line >= hi, "the description's end shares a line")
            puts.append((line, line, "".join(blocks)))
    out, done = [], 0
    for a, b, piece in sorted(puts, key=lambda p: p[:2]):
        out += [text[done:a], piece]
        done = b
    return "".join([*out, text[done:]])


def _levels(tags) -> set[str]:
    return {part for t in tags for part in t.split("|")}


def changed(now: State, rating: str, green: str, add: list[str], remove: list[str], default_rating: int) -> State:
    """The state after one change. A restore acts only where the rating is the one that was set."""
    op, *numbers = rating.split(":")
    value, have = now.rating, default_rating if now.rating is None else now.rating
    if op == "set":
        value = int(numbers[0])
    elif op == "restore" and have == int(numbers[0]):
        value = int(numbers[1])
    lists = dict(now.lists)
    lit = GREEN in lists[LABELS]
    if green == "set" and not lit:
        lists[LABELS] = tuple(sorted((*lists[LABELS], GREEN)))
    elif green == "restore:0" and lit:
        lists[LABELS] = tuple(x for x in lists[LABELS] if x != GREEN)
    if add or remove:
        for t in (*add, *remove):
            need(escape(t) == t, f"the tag {t!r} would need escaping")
        tags = {*lists[HIERARCHY]} - {*remove} | {*add}
        gone = _levels(remove) - _levels(tags)
        lists[HIERARCHY] = tuple(sorted(tags))
        lists[SUBJECT] = tuple(sorted({*lists[SUBJECT]} - gone | _levels(add)))
    return State(value, lists)


def edit_text(text: str, rating: str, green: str, add: list[str], remove: list[str], default_rating: int = 1) -> tuple[str, int, bool]:
    """A sidecar's text after one change, and the rating and the green label that were there before."""
    at = Layout.of(text)
    now = State.of(text, at)
    new = changed(now, rating, green, add, remove, default_rating)
    return rewritten(text, at, now, new), default_rating if now.rating is None else now.rating, GREEN in now.lists[LABELS]


EDITED = "text string, before_rating int, before_green boolean, error string"


def edit_sidecars(default_rating: int = 1) -> object:
    """A column function of (file, text, rating, green, add, remove): the edited text and what was there before, or an
    error and the text as it was. A null text gets a fresh sidecar."""

    @F.pandas_udf(EDITED)
    def edit(file: pd.Series, text: pd.Series, rating: pd.Series, green: pd.Series, add: pd.Series, remove: pd.Series) -> pd.DataFrame:
        out = []
        for f, t, r, g, a, d in zip(file, text, rating, green, add, remove):
            try:
                out.append((*edit_text(blank(f) if t is None else t, r, g, list(a), list(d), default_rating), None))
            except SidecarError as e:
                out.append((t, None, None, str(e)))
        return pd.DataFrame(out, columns=["text", "before_rating", "before_green", "error"])

    return edit


def rating(text: Column) -> Column:
    """A sidecar's rating; null without one."""
    return attribute(text, RATING).try_cast("int")


def readable(text: Column) -> Column:
    """Whether a text has exactly one description."""
    return F.regexp_count(text, F.lit(OPEN)) == 1
