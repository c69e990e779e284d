"""Checks of rendered documents against their outline and manifest.

Documents (keys, markdown) are read line by line inside their row, so no text is
shuffled. Every check gives findings (keys, check_id, severity, section_id, reference,
line_number, artifact); `ordered` puts them in canonical order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.text import lines

# Lines that say nothing, phrases of release notes, ids that should not show, a doubtful mark.
FILLERS = (
    "No strong evidence was carried into this rendered section.", "No variant families were identified for this checkpoint.", "No algorithm capsules were emitted for this checkpoint.",
    "No active subsystems were identified for this checkpoint.", "No active build-source concepts were identified for this checkpoint.", "No strong design-note anchors were identified for this checkpoint.",
    "No explicit limitation or constraint signals were identified for this checkpoint.",
)
PHRASES = ("since last", "new this quarter", "in this release", "previous version", "changed since", "recent change", "new this checkpoint")
LEAKED_ID = r"\b(?:subsystem|module|interface|context_node)::[A-Za-z0-9_.:/-]+\b"
CONTRADICTORY = r"^\s*TBD\s*-\s*\S"
DOCUMENT, MANIFEST = "checkpoint.md", "render_manifest.json"
COLUMNS = ["check_id", "severity", "section_id", "reference", "line_number", "artifact"]


def headings(ls: str, prefix: str) -> Column:
    """The places, from 1, of the lines of an array column that begin with a prefix."""
    return F.filter(F.transform(F.col(ls), lambda x, i: F.when(F.startswith(x, F.lit(prefix)), i + 1)), lambda i: i.isNotNull())


def blocks(rows: DataFrame, keep: list[str], ls: str, prefix: str) -> DataFrame:
    """(keep, idx, title, place, body): the blocks below the headings with a prefix in the array of lines `ls`; place counts its lines from 1.

    Lines and places are columns of their own, so that each is made once a row.
    """
    at = rows.select(*keep, F.col(ls).alias("_ls"), headings(ls, prefix).alias("_at"))
    each = at.select(*keep, "_ls", "_at", F.posexplode_outer("_at").alias("idx", "place")).filter("place IS NOT NULL")
    until = F.coalesce(F.try_element_at("_at", F.col("idx") + 2), F.size("_ls") + 1)
    return each.select(*keep, "idx", F.trim(F.substring(F.element_at("_ls", F.col("place")), len(prefix) + 1, 1 << 20)).alias("title"), "place", F.slice("_ls", F.col("place") + 1, until - F.col("place") - 1).alias("body"))


def paragraphs(body: Column) -> Column:
    """The paragraphs of an array of lines, each as one line."""
    text = F.regexp_replace(F.array_join(F.transform(body, F.trim), "\n"), r"^\n+|\n+$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, r"\n\n+"), lambda x: F.translate(x, "\n", " ")))


def sections(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, title, line, body): the top sections of each document, counted from 0."""
    rows = documents.select(*keys, lines(F.col("markdown")).alias("ls"))
    return blocks(rows, keys, "ls", "## ").withColumn("line", F.col("place").cast("long")).drop("place")


def _found(check: str, severity: str, section: Column | None = None, reference: Column | None = None, line: Column | None = None, artifact: str = DOCUMENT) -> list[Column]:
    nothing = F.lit(None)
    return [F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), (nothing if section is None else section).cast("string").alias("section_id"),
            (nothing if reference is None else reference).cast("string").alias("reference"), (nothing if line is None else line).cast("long").alias("line_number"), F.lit(artifact).alias("artifact")]


def section_findings(outline: DataFrame, manifest: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Included sections that are missing or out of order, omitted ones that are rendered, and a manifest whose titles differ from the document's.

    outline: (keys, section_id, title, status, position); manifest: (keys, section_id,
    title, position). Positions order the sections; a title that a document
    repeats stands at its last place. Titles of a document are gathered, which are few.
    """
    order = Window.partitionBy(*keys).orderBy("position")
    rendered = sections(documents, keys)
    at_title = rendered.groupBy(*keys, "title").agg(F.max(F.struct("idx", "line")).alias("m")).select(*keys, "title", F.col("m.idx").alias("md"), F.col("m.line").alias("line"))
    in_manifest = manifest.withColumn("mf", F.row_number().over(order) - 1).select(*keys, "section_id", "mf")
    included = outline.filter("status = 'included'").withColumn("expected", F.row_number().over(order) - 1)
    judged = included.join(in_manifest, [*keys, "section_id"], "left").join(at_title, [*keys, "title"], "left")
    wrong = judged.filter(~F.col("mf").eqNullSafe(F.col("expected")) | ~F.col("md").eqNullSafe(F.col("expected")))
    missing = wrong.select(*keys, *_found("included_section_missing", "error", F.col("section_id"), F.col("title"), F.col("line")))
    shown = outline.filter("status = 'omitted'").join(at_title, [*keys, "title"], "left_semi").select(*keys, *_found("omitted_section_rendered", "error", F.col("section_id"), F.col("title")))
    titles = lambda df, place: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), "title"))), lambda x: x["title"]).alias("titles"))
    both = titles(manifest, "position").withColumnRenamed("titles", "mt").join(titles(rendered, "idx").withColumnRenamed("titles", "dt"), keys, "full_outer")
    empty = F.array().cast("array<string>")
    differ = both.filter(F.coalesce("mt", empty) != F.coalesce("dt", empty)).select(*keys, *_found("render_manifest_mismatch", "error", None, F.array_join(F.coalesce("dt", empty), " -> "), None, MANIFEST))
    return missing.unionByName(shown).unionByName(differ)


def subsection_findings(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Subsections whose heading stands twice in its section, that have bullets or not two paragraphs, that hold only `TBD` in one, or only a scope bullet."""
    s = sections(documents, keys)
    of = s.select(*keys, F.col("title").alias("section_id"), F.col("line").alias("above"), F.col("body").alias("ls"))
    subs = blocks(of, [*keys, "section_id", "above"], "ls", "### ").select(*keys, "section_id", "title", (F.col("above") + F.col("place")).alias("line"), "body")
    told = subs.select("*", F.count("*").over(Window.partitionBy(*keys, "section_id", "title")).alias("times"), F.filter(F.transform("body", F.trim), lambda x: F.startswith(x, F.lit("- "))).alias("bullets"), paragraphs(F.col("body")).alias("ps"))
    thin = (F.size("bullets") == 1) & F.startswith(F.try_element_at("bullets", F.lit(1)), F.lit("- Scope:"))
    shape = (F.size("bullets") > 0) | (F.size("ps") != 2)
    twice = told.filter("times > 1").groupBy(*keys, "section_id", "title").agg(F.lit(1)).select(*keys, *_found("dependency_subsection_shape_invalid", "error", F.col("section_id"), F.col("title")))
    once = told.filter("times = 1")
    return reduce(DataFrame.unionByName, [
        twice, once.filter(shape).select(*keys, *_found("dependency_subsection_shape_invalid", "error", F.col("section_id"), F.col("title"), F.col("line"))),
        once.filter(~shape & F.array_contains("ps", "TBD")).select(*keys, *_found("dependency_summary_tbd", "warning", F.col("section_id"), F.col("title"), F.col("line"))),
        once.filter(thin).select(*keys, *_found("algorithm_capsule_thin", "warning", F.col("section_id"), F.col("title"), F.col("line")))])


def line_findings(documents: DataFrame, keys: list[str], core: tuple[str, ...] = ()) -> DataFrame:
    """Phrases of release notes behind the first section's heading, leaked ids, doubtful marks, and lines that say nothing, an error in the core sections."""
    at = documents.select(*keys, lines(F.col("markdown")).alias("ls"))
    begin = F.coalesce(F.try_element_at(headings("ls", "## "), F.lit(1)), F.lit(1 << 30))
    each = at.select(*keys, begin.alias("begin"), "ls").select(*keys, "begin", F.posexplode_outer("ls").alias("n", "line")).withColumn("n", F.col("n") + 1)
    phrase = F.lit(None).cast("string")
    for p in reversed(PHRASES):
        phrase = F.when(F.lower("line").contains(p), p).otherwise(phrase)
    said = each.filter("n >= begin").withColumn("p", phrase).filter("p IS NOT NULL").select(*keys, *_found("release_note_phrase", "warning", None, F.col("p"), F.col("n")))
    leaked = each.filter(F.col("line").rlike(LEAKED_ID)).select(*keys, *_found("raw_internal_id_leak", "error", None, F.trim("line"), F.col("n")))
    doubtful = each.filter(F.col("line").rlike(CONTRADICTORY)).select(*keys, *_found("contradictory_tbd_phrase", "warning", None, F.trim("line"), F.col("n")))
    body = sections(documents, keys).select(*keys, "title", "line", F.posexplode_outer("body").alias("k", "text"))
    empty = body.filter(F.trim("text").isin(*FILLERS) & (F.col("title") != "Introduction"))
    is_core = F.col("title").isin(*core) if core else F.lit(False)
    weak = [empty.filter(c).select(*keys, *_found(check, severity, F.col("title"), F.trim("text"), F.col("line") + F.col("k") + 1)) for c, check, severity in ((is_core, "weak_core_section", "error"), (~is_core, "weak_optional_section", "warning"))]
    return reduce(DataFrame.unionByName, [said, leaked, doubtful, *weak])


def ordered(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings numbered in canonical order, and whether their document's render is to be given up: where any is an error."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    w = Window.partitionBy(*keys).orderBy("severity", "check_id", blank("section_id"), blank("reference"), F.coalesce("line_number", F.lit(0)), blank("artifact"))
    return findings.select("*", F.row_number().over(w).alias("place"), F.max((F.col("severity") == "error").cast("int")).over(Window.partitionBy(*keys)).cast("boolean").alias("aborts"))


def counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error_count, warning_count)."""
    return findings.groupBy(*keys).agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
