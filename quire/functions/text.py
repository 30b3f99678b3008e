"""Column expressions over lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

FULL = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
#: What Unicode calls White_Space, as \\p{IsWhite_Space} does.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CJK = "一-鿿"
CN = "一二三四五六七八九十"
TITLE_WORDS = ("ABSTRACT", "INTRODUCTION", "REFERENCES", "REFERENCE")
NUMBERING = rf"(?s)^(?:([0-9]+(?:\.[0-9]+)*)|（[{CN}]+[）)]?|[{CN}]+[）)]?|\([0-9]+\)|（[0-9]+）)[\p{{IsWhite_Space}}]*[.、．]?[\p{{IsWhite_Space}}]*(.*)$"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends (Spark's trim alone only knows the blank)."""
    return F.trim(c, F.lit(WHITE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def half_width(c: Column) -> Column:
    """STR-1: full-width digits and letters as ASCII; other full-width signs stay."""
    return F.translate(c, FULL, HALF)


def half_width_all(c: Column) -> Column:
    """STR-5: the whole full-width block and the ideographic blank."""
    return F.translate(c, WIDE, NARROW)


def title_level(c: Column) -> Column:
    """TTL-1: heading level from a line's numbering or keyword; null if it is no heading."""
    t = strip(c)
    rest = strip(F.regexp_extract(t, NUMBERING, 2))
    digits = F.regexp_extract(t, NUMBERING, 1)
    dots = F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit("")))
    return (
        F.when(F.upper(t).isin(*TITLE_WORDS), F.lit(2))
        .when(rest != "", F.least(F.lit(6), F.greatest(F.lit(2), dots + 2)))
        .cast("int")
    )


def is_title(c: Column) -> Column:
    """Whether there is a title_level, without working it out."""
    t = strip(c)
    return F.coalesce(F.upper(t).isin(*TITLE_WORDS) | (strip(F.regexp_extract(t, NUMBERING, 2)) != ""), F.lit(False))


def is_marked(c: Column) -> Column:
    """The line already is a Markdown heading."""
    return lstrip(c).startswith("#")


def title_prefixed(c: Column, hint: Column | None = None, numbering: bool = True) -> Column:
    """TTL-2: heading marks by numbering, else by the level of a matching hint."""
    level = F.when((F.length(c) <= S.TITLE_MAX), title_level(c)) if numbering else F.lit(None).cast("int")
    level = F.coalesce(level, hint) if hint is not None else level
    return F.when(is_marked(c) | level.isNull(), c).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), c))


def hint_level(c: Column) -> Column:
    """TTL-3: level of a layout title: its numbering, or 2 if it is short and no sentence."""
    t = strip(c)
    n = F.length(t)
    return F.coalesce(title_level(t), F.when((n >= 1) & (n <= S.HINT_MAX) & ~t.rlike("[。，；：]$"), F.lit(2)))


def is_page_number(c: Column) -> Column:
    """FLT-14"""
    return strip(c).rlike("^[0-9]{1,4}$")


def is_isolated_marker(c: Column) -> Column:
    """FLT-16: a list marker with nothing after it."""
    t = strip(c)
    n = F.length(t)
    bullet = t.rlike("^[-•·*]")
    letter = (n <= 3) & t.rlike("^[A-Za-z][)）.、，,]")
    bracket = (n >= 3) & t.rlike(rf"(?s)^（[\p{{N}}{CN}〇零]+）$")
    return (t != "") & ~t.startswith("#") & (n <= 6) & (bullet | letter | bracket)


def is_noise_fragment(c: Column) -> Column:
    """FLT-15: a single character that is no marker."""
    t = strip(c)
    return (F.length(t) == 1) & (t != "#") & ~is_isolated_marker(t)


def garbled(c: Column) -> Column:
    """FLT-1: number of control, replacement and private-use characters."""
    return F.length(F.regexp_replace(c, r"[^\p{Cc}�-]", ""))


def is_garbled(total: Column, bad: Column) -> Column:
    """FLT-2"""
    return (total > S.GARBLED_MIN) & (bad * 100 >= total * S.GARBLED_PERCENT)


def is_prose(c: Column) -> Column:
    """A long cell, or one that ends a sentence (part of FLT-12)."""
    return (F.length(c) >= S.PROSE_LENGTH) | c.rlike("[。，；：]$")


def escape_html(c: Column) -> Column:
    """GRD-10"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def table_html(c: Column) -> Column:
    """GRD-11: from the first opening tag to the last closing one, whose ``>`` may be missing."""
    t = F.regexp_extract(c, "(?s)(<table.*</table)", 1)
    return F.when(t != "", F.concat(t, F.lit(">"))).otherwise(strip(c))


def span_attributes(colspan: Column, rowspan: Column) -> Column:
    """STR-9"""
    return F.concat(F.when(colspan > 1, F.format_string(' colspan="%d"', colspan)).otherwise(F.lit("")), F.when(rowspan > 1, F.format_string(' rowspan="%d"', rowspan)).otherwise(F.lit("")))


def snapshot_name(c: Column) -> Column:
    """STR-4"""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def normalized(c: Column) -> Column:
    """STR-6: text for comparing extractions: half-width, without links and marks, lower-case letters and digits, CJK and core punctuation."""
    c = half_width_all(c)
    c = F.regexp_replace(c, r"https?://\S+", "")
    c = F.regexp_replace(c, r"\[([^\[\]]*)\]\([^()]*\)", "$1")
    c = F.regexp_replace(c, r"[#>*`|_~]", "")
    return F.lower(F.regexp_replace(c, rf"[^{CJK}A-Za-z0-9。，、；：？！（）《》.,;:?!()]", ""))


def plain_line(c: Column) -> Column:
    """STR-7: a Markdown line without its marks; null for lines that carry no text (images, separators, page numbers)."""
    t = strip(c)
    gone = t.rlike(r"^!\[") | t.rlike(r"^[|:\- ]+$") | t.rlike("^[0-9]{1,3}$")
    t = F.regexp_replace(t, r"^#{1,6}\s+|^[-*+]\s+|^>\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\|", " "), r"[.…·]{3,}", " ")
    t = strip(t)
    return F.when(~gone & (t != ""), t)


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams, by one pass of a look-ahead; empty for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def set_recall(truth: Column, found: Column) -> Column:
    """Share of the first set that is in the second; 0 for an empty first set."""
    return F.size(F.array_intersect(truth, found)).cast("double") / F.greatest(F.size(truth), F.lit(1))


def character_counts(c: Column) -> dict[str, Column]:
    """MET-8"""
    keep = lambda k: F.length(F.regexp_replace(c, f"[^{k}]", ""))
    return {"n_lines": F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1, "n_cjk": keep(CJK), "n_letters": keep("A-Za-z"), "n_digits": keep("0-9")}


def heading_marks(c: Column) -> Column:
    """MET-6: number of marks of a Markdown heading, 0 for other lines."""
    return F.length(F.regexp_extract(c, r"^(#{1,6})\s", 1))
