"""Column functions on names, labels, markup and change lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of photos (fixed values).
RAW_EXTENSIONS = ("cr2", "cr3", "nef", "arw", "raf", "dng", "orf", "rw2")
JPEG_EXTENSIONS = ("jpg", "jpeg")
#: Reasons, in the order in which judging gives them (fixed values).
REASONS = ("sharpest", "eyes-closed", "soft-eyes", "face-cut", "smile", "no-face", "face-hidden", "small-face", "soft-frame")


def file_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """The part before the last dot; the whole name if it has none."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def short_name(name: Column) -> Column:
    """A frame's short name: without extension, after the last hyphen."""
    return F.substring_index(stem(name), "-", -1)


def image_names(name: Column, face: Column) -> dict[str, Column]:
    """Names of the images kept for a frame and one of its faces."""
    s = stem(name)
    return {"display": F.concat(s, F.lit(".jpg")), "thumb": F.concat(s, F.lit("_t.jpg")), "eyes": F.concat(s, F.lit("_eyes"), face.cast("string"), F.lit(".jpg")), "face": F.concat(s, F.lit("_face"), face.cast("string"), F.lit(".jpg"))}


#: Wordings of reasons and of notes on crops (fixed values).
REASON_TEXT = {"eyes-closed": "eyes closed", "soft-eyes": "soft eyes", "no-face": "no face", "face-hidden": "face hidden", "small-face": "small face", "face-cut": "face cut", "sharpest": "sharpest", "smile": "smile", "soft-frame": "soft"}
NOTE_TEXT = {"original": "as shot", "eyes-on-third": "eyes on third", "lead-room": "lead room", "centered": "centred", "clean-edges": "clean edges", "subject-pops": "subject pops"}
BAD, GOOD = ("eyes-closed", "soft-eyes", "soft-frame", "face-cut"), ("sharpest", "smile")


def wording(slug: Column, texts: dict[str, str]) -> Column:
    """A slug's wording, or the slug itself."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in texts.items() for x in kv)), slug), slug)


def tone(reason: Column) -> Column:
    return F.when(reason.isin(*BAD), "bad").when(reason.isin(*GOOD), "good").otherwise("info")


def ratio_text(n: Column, d: Column) -> Column:
    return F.concat_ws(":", n.cast("string"), d.cast("string"))


def eyes_text(blink: Column, closed: float = 0.45, half: float = 0.3) -> Column:
    """Wording for two eyes."""
    hi, lo = F.greatest(blink[0], blink[1]), F.least(blink[0], blink[1])
    return F.when((hi >= closed) & (lo >= half), "eyes closed").when(hi >= closed, "one eye closed").when(hi >= half, "half-closed").otherwise("eyes open")


def badge(mark: Column, decided: Column) -> Column:
    """A frame's sign by its effective mark; brackets if the user has not decided."""
    sign = F.when(mark == "pick", "★").when(mark == "reject", "✗").otherwise("?")
    return F.when(decided, sign).otherwise(F.concat(F.lit("("), sign, F.lit(")")))


def lift(luma: Column) -> Column:
    """How much a thumbnail of a face is brightened: 110 over its luma, 1 to 3; 1 if that is unknown."""
    return F.when(luma.isNull() | (luma <= 0), 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(3.0), 110.0 / luma)))


def escape(s: Column) -> Column:
    """Markup characters as entities, the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def queue_name(roll: Column, suffix: str) -> Column:
    """A queue file's name: the roll with slashes as percent signs."""
    return F.concat(F.translate(roll, "/", "%"), F.lit("." + suffix))


def attribute(markup: Column, name: str) -> Column:
    """The value of an attribute that follows white space and stands in double quotes; null if there is none."""
    pattern = r'\s' + name + r'="([^"]*)"'
    return F.when(markup.rlike(pattern), F.regexp_extract(markup, pattern, 1))


def list_items(markup: Column, item: str = "rdf:li", element: str | None = None) -> Column:
    """The raw texts of list items, of one element where it is named."""
    inner = F.regexp_extract(markup, f"(?s)<{element}>(.*?)</{element}>", 1) if element else markup
    return F.regexp_extract_all(inner, F.lit(f"(?s)<{item}>(.*?)</{item}>"), F.lit(1))


def list_or_dash(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.array_join(tags, ",")).otherwise("-")


def change_line(file: Column, rating: Column, green: Column, add: Column, remove: Column) -> Column:
    """A change as a line of five fields parted by tabs."""
    return F.concat_ws("\t", file, rating, green, list_or_dash(add), list_or_dash(remove))


def parse_change(line: Column) -> dict[str, Column]:
    """The fields of a change line, and whether they are well formed; ratings are 8-bit numbers."""
    f = F.split(line, "\t", -1)
    items = lambda c: F.when(c == "-", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    field = lambda k: F.coalesce(F.get(f, F.lit(k)), F.lit(""))
    small = F.forall(F.regexp_extract_all(field(1), F.lit("-?[0-9]+"), F.lit(0)), lambda n: n.try_cast("tinyint").isNotNull())
    fine = (F.size(f) == 5) & field(1).rlike("^(keep|set:-?[0-9]{1,3}|restore:-?[0-9]{1,3}:-?[0-9]{1,3})$") & small & field(2).rlike("^(keep|set|restore:[01])$")
    return {"valid": fine, "file": field(0), "rating": field(1), "green": field(2), "add": items(field(3)), "remove": items(field(4))}
