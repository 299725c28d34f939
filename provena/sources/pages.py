"""HTML as units of text by heading path, as one expression."""

from __future__ import annotations

import re
from html import escape, unescape

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# A tag's attributes may hold `>` within quotes; a tag whose quotes don't close ends at the first `>`.
_ATTRIBUTES = r"""[^"'>]*+(?:"[^"]*"[^"'>]*+|'[^']*'[^"'>]*+)*+"""
HIDDEN = rf"(?is)<!--.*?(?:--!?>|\z)|<(script|style)\b(?:{_ATTRIBUTES}|[^>]*)>.*?(?:</\1\b[^>]*>|\z)"
TAG = rf"(?s)</?[a-zA-Z]{_ATTRIBUTES}>|</?[a-zA-Z][^>]*>|<[!?][^>]*>"
# Tags of headings with their attributes, and all other tags: taken out first, so no attribute looks like a heading.
OF_HEADING, OTHER_TAG = rf"(?is)<(/?h[1-6])\b(?:{_ATTRIBUTES}|[^>]*)>", rf"(?is)<(?!/?h[1-6]\b)/?[a-z](?:{_ATTRIBUTES}|[^>]*)>|<[!?][^>]*>"
HEADING = rf"(?is)^<h([1-6])\b(?:{_ATTRIBUTES}|[^>]*)>(.*?)</h\1\s*>(.*)$"
#: References that are replaced without Python; the last three only after tags are gone, and `&amp;` last of all.
COMMON = "quot apos nbsp middot copy reg trade mdash ndash hellip lsquo rsquo ldquo rdquo bull laquo raquo euro deg times".split()
KEPT = ("lt", "gt", "amp")
_OTHER = rf"&(?!(?:{'|'.join((*COMMON, *KEPT))});)[A-Za-z#]"
_REFERENCE = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


@F.pandas_udf(StringType())
def _rare(s: pd.Series) -> pd.Series:
    """Pages with their references read; what would be markup stays a reference."""
    return s.map(lambda t: t and _REFERENCE.sub(lambda m: escape(unescape(m[0]), quote=False), t))


def visible(html: Column) -> Column:
    """A page without comments, scripts and styles, and without references but those of markup; Python sees only pages with rare references."""
    t = F.regexp_replace(html, HIDDEN, " ")
    rare = t.rlike(_OTHER)
    t = F.coalesce(_rare(F.when(rare, t)), t)
    for name in COMMON:
        t = F.replace(t, F.lit(f"&{name};"), F.lit(unescape(f"&{name};")))
    return t


def plain(markup: Column) -> Column:
    """Words of a piece of a visible page, one space between them; a tag parts words."""
    t = F.regexp_replace(markup, TAG, " ")
    for name in KEPT:
        t = F.replace(t, F.lit(f"&{name};"), F.lit(unescape(f"&{name};")))
    return F.trim(F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]+", " "))


def heading_units(page: Column) -> Column:
    """array<struct<path, text>> of a visible page, units without text left out.

    A heading of level n keeps the first n - 1 titles of the path before it.  What stands before the first heading has an empty path; a
    heading that isn't closed takes the text up to the next one with it.
    """
    page = F.regexp_replace(F.regexp_replace(page, OF_HEADING, "<$1>"), OTHER_TAG, " ")
    pieces = F.split(page, r"(?i)(?=<h[1-6]\b)")
    first = F.get(pieces, F.lit(0))  # a page that starts with a heading has no piece before it
    unit = F.struct(F.lit("").alias("path"), F.when(first.rlike(r"(?i)^<h[1-6]\b"), "").otherwise(plain(first)).alias("text"))
    heads = F.filter(pieces, lambda p: p.rlike(HEADING))
    heads = F.transform(heads, lambda p: F.struct(F.regexp_extract(p, HEADING, 1).cast("int").alias("level"), plain(F.regexp_extract(p, HEADING, 2)).alias("title"), plain(F.regexp_extract(p, HEADING, 3)).alias("text")))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array(unit).alias("units"))

    def step(a: Column, h: Column) -> Column:
        path = F.concat(F.slice(a["path"], 1, h["level"] - 1), F.array(h["title"]))
        label = F.array_join(F.filter(path, lambda x: x != ""), " > ")
        return F.struct(path.alias("path"), F.concat(a["units"], F.array(F.struct(label.alias("path"), h["text"].alias("text")))).alias("units"))

    return F.filter(F.aggregate(heads, start, step, lambda a: a["units"]), lambda u: u["text"] != "")
