"""Whole runs composed of the operators: an answer's evidence, a repository's document, and proposals after a change. Everything stays lazy until it is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators import changes, outline, rendering, retrieval, usage, validation
from repolith.operators import repository as P
from repolith.operators.manifests import build_sources
from repolith.session import cut


@dataclass(frozen=True)
class Tables:
    """The tables of a workspace."""

    scan: DataFrame
    nodes: DataFrame
    edges: DataFrame
    dependencies: DataFrame
    chunks: DataFrame


def answer_evidence(tables: Tables, questions: DataFrame, k: int = 6) -> DataFrame:
    """(csc_id, question_id, rank, chunk_id, source_path, line_start, line_end, quote, status): what each question is answered from.

    The k best chunks with their citations; `insufficient_evidence` where none shares
    a word with the question, else `grounded`.
    """
    best = retrieval.top_k(tables.chunks, questions, k)
    cited = retrieval.citations(retrieval.chunk_rows(tables.chunks))
    status = F.when(F.col("score") > 0, "grounded").otherwise("insufficient_evidence")
    return best.join(cited, ["csc_id", "chunk_id"]).select("csc_id", "question_id", "rank", "chunk_id", "source_path", "line_start", "line_end", "quote", status.alias("status"))


def section_lines(tables: Tables) -> DataFrame:
    """(csc_id, section_id, place, line): the lines of every section that the outline includes, as told without a model.

    Sections on tokens name their modules, at most ten; the others are told from the
    operators' rows. A section without evidence has one line that says so.
    """
    t = tables
    hits = outline.module_hits(t.scan, t.nodes, outline.SECTION_TOKENS)
    each = lambda df, section, place, line: df.select("csc_id", F.lit(section).alias("section_id"), place.alias("place"), line.alias("line"))
    counts = hits.groupBy("csc_id").agg(F.count("*").alias("m"), F.count_distinct("subsystem_id").alias("s"))
    texts = outline.subsystem_texts(t.scan, t.nodes)
    parts = [
        each(counts, "introduction", F.lit("0"), F.concat(F.lit("This document describes "), "m", F.lit(" modules in "), "s", F.lit(" subsystems."))),
        each(texts, "architectural_overview", F.col("subsystem_id"), F.concat(F.lit("- `"), "display_name", F.lit("`"))), each(texts, "subsystems_modules", F.col("subsystem_id"), F.concat(F.lit("### "), "display_name", F.lit("\n\n"), "summary")),
        each(outline.capsules(outline.algorithm_candidates(t.edges, t.nodes)), "algorithms_core_logic", F.col("capsule_id"), F.concat(F.lit("- "), "scope", F.lit(" ("), "status", F.lit(")"))),
        each(outline.interface_kinds(t.scan, t.nodes), "interfaces", F.col("interface_id"), F.concat(F.lit("- "), "title")), each(outline.context_nodes(t.scan, t.nodes), "system_context", F.col("node_id"), F.concat(F.lit("- "), "title", F.lit(": "), "modules", F.lit(" modules"))),
        each(build_sources(t.scan), "build_development_infrastructure", F.col("path"), F.concat(F.lit("- "), "path", F.lit(" ("), "ecosystem", F.lit(")"))),
        each(outline.design_notes(outline.insights(t.edges, t.nodes, t.dependencies)), "design_notes_rationale", F.format_string("%02d", F.col("n")), F.concat(F.lit("- "), "title")),
    ]
    told = usage.narratives(usage.usage(t.scan, t.dependencies)).filter("section_target = 'dependencies'")
    few = outline.capped(told, ["csc_id"], [F.col("package"), F.coalesce("ecosystem", F.lit(""))], 10)
    parts.append(each(few, "dependencies", F.format_string("%02d", F.col("n")), F.concat(F.lit("### "), "package", F.lit("\n\n"), "general", F.lit("\n\n"), "usage")))
    for section in outline.SECTION_TOKENS:
        named = outline.capped(hits.filter(section).select("csc_id", "path"), ["csc_id"], [F.col("path")], 10)
        parts.append(each(named, section, F.format_string("%02d", F.col("n")), F.concat(F.lit("- `"), "path", F.lit("`"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_sections(tables: Tables) -> DataFrame:
    """(csc_id, title, place, body): the included sections of each repository's document with their text, `TBD` where nothing is known. A body gathers its section's lines, subsystems and capsules, which are few beside modules."""
    included = outline.section_scores(tables.scan, tables.nodes, tables.edges, tables.dependencies, build_sources(tables.scan)).filter("status = 'included'").select("csc_id", "section_id").unionByName(
        outline.context_scores(tables.scan, tables.nodes).filter("status = 'included'").select("csc_id", "section_id"))
    bodies = section_lines(tables).groupBy("csc_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    order = ["introduction", "architectural_overview", "system_context", "subsystems_modules", "interfaces", "algorithms_core_logic", "dependencies", "build_development_infrastructure", "strategy_variants_design_alternatives", *outline.SECTION_TOKENS, "design_notes_rationale"]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("section_id"))
    return included.join(bodies, ["csc_id", "section_id"], "left").select("csc_id", F.col("section_id").alias("title"), place.alias("place"), "body")


def generate_documents(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents (csc_id, markdown, sections), made once and kept in the shared folder, and their findings in canonical order; a document whose findings abort is not to be written."""
    documents = cut(rendering.documents(document_sections(tables), ["csc_id"]))
    findings = validation.line_findings(documents, ["csc_id"], outline.CORE)
    return documents, validation.ordered(findings, ["csc_id"])


def propose_updates(diffs: DataFrame, titles: DataFrame) -> DataFrame:
    """(csc_id, section, status, files, reasons): for each section that changed files (csc_id, text: diffs) concern, whether the document has it.

    titles: (csc_id, title) of the sections that exist; letter case aside. A
    section that is missing is to be written anew.
    """
    per = changes.file_changes(changes.diff_lines(diffs), [c for c in diffs.columns if c != "text"] + ["path"]).select("csc_id", "section", "path", "change_kind").distinct()
    wanted = per.groupBy("csc_id", "section").agg(F.count_distinct("path").alias("files"), F.array_sort(F.collect_set("change_kind")).alias("reasons"))  # of five kinds
    have = titles.select("csc_id", F.lower("title").alias("low")).distinct().withColumn("had", F.lit(True))
    return wanted.withColumn("low", F.lower("section")).join(have, ["csc_id", "low"], "left").select("csc_id", "section", F.when(F.col("had"), "update").otherwise("create").alias("status"), "files", "reasons")


def answer_markdown(evidence: DataFrame) -> DataFrame:
    """(csc_id, question_id, markdown): the evidence of each question, at most k rows, as a list of quotes with their places."""
    line = F.concat(F.lit("- "), "source_path", F.lit(":"), F.coalesce(F.col("line_start").cast("string"), F.lit("?")), F.lit(" "), "quote")
    g = evidence.groupBy("csc_id", "question_id").agg(F.min("status").alias("status"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return g.select("csc_id", "question_id", F.concat(F.lit("## Evidence ("), "status", F.lit(")\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def file_markdown(scan: DataFrame) -> DataFrame:
    """(csc_id, path, markdown): each scan of a file as a page: language, functions, classes and imports."""
    listed = lambda title, c: F.concat(F.lit(f"\n## {title}\n\n"), F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit("- "), F.array_join(c, "\n- "))).otherwise("None."), F.lit("\n"))
    page = F.concat(F.lit("# "), "path", F.lit("\n\nLanguage: "), P.language_of(F.col("path")), F.lit("\n"), listed("Functions", F.col("functions")), listed("Classes", F.col("classes")), listed("Imports", F.col("imports")))
    return scan.filter("path IS NOT NULL").select("csc_id", "path", page.alias("markdown")).distinct()
