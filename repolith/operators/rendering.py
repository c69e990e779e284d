"""Markdown documents from section rows, and section rows back from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Included sections (keys, place, title, body) with their number from 1; sections without body have `TBD`."""
    w = Window.partitionBy(*keys).orderBy("place", "title")
    return sections.select(*keys, F.row_number().over(w).alias("number"), "title", F.coalesce(F.nullif(F.trim("body"), F.lit("")), F.lit("TBD")).alias("body"))


def documents(sections: DataFrame, keys: list[str], heading: str = "# ") -> DataFrame:
    """(keys, markdown, sections): one document for each key from its numbered sections. A document gathers its own sections only.

    A line of a body that would read as a section's heading gets a backslash before it.
    """
    quoted = F.regexp_replace("body", r"(^|\n)(\\*## )", r"$1\\$2")
    piece = F.struct("number", F.concat(F.lit("## "), "number", F.lit(". "), "title", F.lit("\n\n"), quoted).alias("text"))
    g = numbered(sections, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return g.select(*keys, F.concat(F.lit(heading), F.concat_ws(" ", *keys), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"), F.size("p").alias("sections"))


def bodies(markdown: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, number, title, body) of documents (keys, markdown): the sections below headings of level two, as `documents` writes them."""
    parts = F.slice(F.split("markdown", r"(?md)^## "), 2, 1 << 20)
    s = markdown.select(*keys, F.posexplode(parts).alias("at", "part"))
    return s.select(*keys, (F.col("at") + 1).alias("number"), F.regexp_extract("part", r"^\d+\. ([^\n]*)", 1).alias("title"), F.regexp_replace(F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n\n?", ""), r"\n+$", ""), r"(^|\n)\\(\\*## )", "$1$2").alias("body"))
