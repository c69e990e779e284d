"""Column functions on text: tokens, lines, keywords, quotes, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9_]+"
#: Posting buckets of a store.
BUCKETS = 64
#: Line ends: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def tokens(text: Column) -> Column:
    """Tokens in order, in lower case; matched before lower-casing, so letters outside ASCII divide tokens. Null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def keywords(text: Column, limit: int = 8) -> Column:
    """The first distinct tokens in order."""
    return F.slice(F.array_distinct(tokens(text)), 1, limit)


def stripped(text: Column) -> Column:
    """Text without white space, as `\\s` has it, at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def lines(text: Column) -> Column:
    """Lines of a text; an end of line at the end of the text begins no further line, and an empty or null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def quote(text: Column, most: int = 200) -> Column:
    """A quote of at most `most` signs and a mark where it was cut; newlines are blanks."""
    flat = F.replace(stripped(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most), r"\s+$", ""), F.lit("..."))).otherwise(flat)


def bucket(term: Column, count: int = BUCKETS) -> Column:
    """Posting bucket of a term: its MD5 digest as a number, modulo a power of two up to 256."""
    return F.pmod(F.conv(F.right(F.md5(term), F.lit(2)), 16, 10).cast("int"), F.lit(count))


def slug(text: Column) -> Column:
    """Lower case with `-` for every run of other signs, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
