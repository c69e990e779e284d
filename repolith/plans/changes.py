"""Queries over changed lines and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.text import lines, slug, stripped
from repolith.operators import changes as C
from repolith.operators.history import VARIANTS
from repolith.plans.repository import _LANGUAGE, _LINES
from repolith.session import load, spread

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "scan_records").select("csc_id", "path", "text").filter("text IS NOT NULL AND path IS NOT NULL").distinct()


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """A diff of each scan of a file in which lines with `return` are removed and all others added. Scans of one text have one digest."""
    t = load(spark, d, "scan_records").select("csc_id", "path", "text", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("scan")).filter("text IS NOT NULL AND path IS NOT NULL")
    t = spread(t, "scan")
    marked = F.array_join(F.transform(lines(F.col("text")), lambda x: F.concat(F.when(x.contains("return"), "-").otherwise("+"), x)), "\n")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1 +1 @@\n"))
    return t.select("csc_id", "digest", "scan", F.concat(head, marked).alias("text"))


def _lit(p: str) -> str:
    return p.replace("'", "''")


def _like(table: dict[str, list[str]]) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN " + " OR ".join(f"regexp_matches(s, '{_lit(p)}')" for p in ps) for k, ps in table.items()) + " ELSE false END"


_CHANGED = f"""WITH t AS (SELECT DISTINCT csc_id, path, text, {_LANGUAGE} AS language FROM scan_records WHERE text IS NOT NULL AND path IS NOT NULL),
  l AS (SELECT csc_id, path, text, language, unnest({_LINES.format('text')}) AS line FROM t),
  m AS (SELECT *, NOT contains(line, 'return') AS added, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l WHERE NOT (contains(line, 'return') AND starts_with(line, '--')) AND NOT (NOT contains(line, 'return') AND starts_with(line, '++'))),
  f AS (SELECT *, {_like(C.SIGNATURES)} AS signature, {_like(C.DEPENDENCIES)} AS dependency,
    s = '' OR CASE language WHEN 'python' THEN starts_with(s, '#') WHEN 'unknown' THEN starts_with(s, '#') OR starts_with(s, '//') OR starts_with(s, '/*') OR starts_with(s, '*') ELSE starts_with(s, '//') OR starts_with(s, '/*') OR starts_with(s, '*') END AS comment FROM m),
  g AS (SELECT csc_id, path, text, count(*) FILTER (WHERE added) AS added, count(*) FILTER (WHERE NOT added) AS removed, count(*) FILTER (WHERE signature) AS signatures, count(*) FILTER (WHERE dependency) AS dependencies, bool_and(comment) AS comment_only FROM f GROUP BY ALL),
  k AS (SELECT csc_id, path, added, removed, signatures, dependencies, comment_only, CASE WHEN signatures > 0 THEN 'interface_change' WHEN dependencies > 0 THEN 'dependency_change' WHEN comment_only THEN 'documentation_only' ELSE 'logic_change' END AS change_kind FROM g)"""
_SECTION = "CASE change_kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SECTIONS.items()) + " END"


def _file_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each file; equal scans are counted apart and then reduced, so that only counts are shuffled."""
    g = C.file_changes(C.diff_lines(_diffs(spark, d)), ["csc_id", "path", "digest", "scan"])
    return g.drop("scan").distinct().drop("digest")


@query(_CHANGED + f" SELECT *, {_SECTION} AS section FROM k")
def ref_x05_parse_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files of diffs with counts, kinds and sections."""
    return _file_changes(spark, d)


@query(_CHANGED + f" SELECT csc_id, change_kind, {_SECTION} AS section, count(*) AS files, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM k GROUP BY ALL")
def ref_a06_impact(spark: SparkSession, d: str) -> DataFrame:
    return _file_changes(spark, d).groupBy("csc_id", "change_kind", "section").agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


_NAMES = " UNION ALL ".join([f"SELECT csc_id, path, regexp_extract(s, '\\b{w}\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM m" for w in C.DECLARING] + ["SELECT csc_id, path, regexp_extract(s, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1) FROM m"])


@query(_CHANGED.replace("NOT (contains(line, 'return') AND starts_with(line, '--')) AND NOT (NOT contains(line, 'return') AND starts_with(line, '++'))", "true") + f" SELECT DISTINCT csc_id, path, name FROM ({_NAMES}) WHERE name <> ''")
def ref_p07_changed_names(spark: SparkSession, d: str) -> DataFrame:
    each = _texts(spark, d).select("csc_id", "path", F.explode_outer(lines(F.col("text"))).alias("line")).filter("line IS NOT NULL")
    return each.select("csc_id", "path", F.explode(C.changed_names(stripped(F.col("line")))).alias("name")).distinct()


@query(_CHANGED + " SELECT csc_id, path, s AS line, signature, dependency FROM f WHERE signature OR dependency GROUP BY ALL")
def ref_p08_signature_lines(spark: SparkSession, d: str) -> DataFrame:
    f = C.line_facts(C.diff_lines(_diffs(spark, d))).filter("signature OR dependency")
    return f.select("csc_id", "path", stripped(F.col("line")).alias("line"), "signature", "dependency").distinct()


@query(_CHANGED + " SELECT csc_id, path, count(*) FILTER (WHERE comment) AS comments, count(*) AS total, bool_and(comment) AS comment_only FROM f GROUP BY csc_id, path, text")
def ref_p09_comment_lines(spark: SparkSession, d: str) -> DataFrame:
    f = C.line_facts(C.diff_lines(_diffs(spark, d))).groupBy("csc_id", "path", "digest", "scan").agg(F.count_if("comment").alias("comments"), F.count("*").alias("total"), F.bool_and("comment").alias("comment_only"))
    return f.drop("scan").distinct().drop("digest")


@query("SELECT DISTINCT csc_id, node_id, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM graph_nodes WHERE label IS NOT NULL")
def ref_p15_slug(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "graph_nodes").filter("label IS NOT NULL").select("csc_id", "node_id", slug(F.col("label")).alias("slug")).distinct()


@query("SELECT DISTINCT csc_id, path, regexp_replace(regexp_extract(lower(path), '([^/]+)$', 1), '\\.[^.]*$', '') AS variant FROM scan_records WHERE regexp_matches(regexp_replace(regexp_extract(lower(path), '([^/]+)$', 1), '\\.[^.]*$', ''), 'strategy|variant|policy|mode|backend|adapter')")
def ref_p16_variants(spark: SparkSession, d: str) -> DataFrame:
    """Files whose name tells of a variant."""
    stem = F.regexp_replace(F.regexp_extract(F.lower("path"), r"([^/]+)$", 1), r"\.[^.]*$", "")
    f = load(spark, d, "scan_records").select("csc_id", "path", stem.alias("variant")).distinct()
    return f.filter(F.exists(F.array(*map(F.lit, VARIANTS)), lambda t: F.contains(F.col("variant"), t)))


_TBD = [("tbd", "TBD"), ("TBD.", "TBD"), ("tbd - see notes", "see notes"), ("TBD: soon", "soon"), ("tbd.", "TBD"), ("", "TBD"), ("  kept  ", "kept"), ("TBD - ", "TBD"), ("not tbd: x", "not tbd: x")]


@query("SELECT value, CASE WHEN t = '' OR lower(t) IN ('tbd', 'tbd.', 'tbd -') THEN 'TBD' WHEN lower(t) LIKE 'tbd - %' THEN coalesce(nullif(trim(substr(t, 7)), ''), 'TBD') WHEN lower(t) LIKE 'tbd:%' OR lower(t) LIKE 'tbd.%' THEN coalesce(nullif(trim(substr(t, 5)), ''), 'TBD') ELSE t END AS cleaned FROM (SELECT value, trim(value) AS t FROM (VALUES " + ", ".join(f"('{a}')" for a, _ in _TBD) + ") AS v(value))")
def ref_p17_marker(spark: SparkSession, d: str) -> DataFrame:
    """Text behind a marker of what is still to be written."""
    t = stripped(F.col("value"))
    rest = F.regexp_replace(t, r"(?i)^tbd(?: - |:|\.)\s*", "")
    return spark.createDataFrame([(a,) for a, _ in _TBD], "value string").select("value", F.when(F.lower(t).isin("", "tbd", "tbd.", "tbd -") | (rest == ""), "TBD").otherwise(rest).alias("cleaned"))


_HEADS = f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, {_LINES.format('text')} AS ls FROM documents WHERE text IS NOT NULL) WHERE len(ls) > 0),
  h AS (SELECT *, regexp_matches(line, '^#{{1,6}} ') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)"""


@query(_HEADS + " SELECT doc_id, section::BIGINT AS section, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+ ', '')) END) AS title, max(CASE WHEN head THEN length(regexp_extract(line, '^#+')) END) AS level, min(n) AS heading_line, count(*) - 1 AS body_lines FROM s WHERE section > 0 GROUP BY ALL")
def ref_p18_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of Markdown texts with title, level and lines; the running count stays within one text."""
    at = load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode_outer(lines(F.col("text"))).alias("n", "line")).filter("line IS NOT NULL")
    head = F.col("line").rlike("^#{1,6} ")
    s = at.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("n"))).filter("section > 0")
    return s.groupBy("doc_id", "section").agg(F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", "^#+ ", "")))).alias("title"), F.max(F.when(F.col("head"), F.length(F.regexp_extract("line", "^#+", 0)))).alias("level"),
                                             (F.min("n") + 1).alias("heading_line"), (F.count("*") - 1).alias("body_lines"))


@query("SELECT DISTINCT csc_id, chunk_id, source_type IN ('sdd_section', 'review_artifact') AS documents, source_type = 'code' AS code, list_has_any([lower(source_type)], ['code', 'file_summary']) AS modules FROM knowledge_chunks")
def ref_p19_evidence_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = load(spark, d, "knowledge_chunks")
    return k.select("csc_id", "chunk_id", F.col("source_type").isin("sdd_section", "review_artifact").alias("documents"), (F.col("source_type") == "code").alias("code"),
                    F.arrays_overlap(F.array(F.lower("source_type")), F.array(F.lit("code"), F.lit("file_summary"))).alias("modules")).distinct()


@query("SELECT score, CASE WHEN score <= 5 THEN 'brief' WHEN score <= 7 THEN 'standard' ELSE 'deep' END AS core, CASE WHEN score <= 6 THEN 'brief' WHEN score <= 8 THEN 'standard' ELSE 'deep' END AS optional FROM (SELECT unnest(range(0, 13)) AS score)")
def ref_p28_depth(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return spark.range(13).withColumnRenamed("id", "score").select("score", F.when(s <= 5, "brief").when(s <= 7, "standard").otherwise("deep").alias("core"), F.when(s <= 6, "brief").when(s <= 8, "standard").otherwise("deep").alias("optional"))


@query("""SELECT DISTINCT csc_id, path, concat_ws(' ', CASE WHEN len(functions) > 0 THEN 'Defines ' || array_to_string(functions[1:3], ', ') || '.' END, CASE WHEN len(classes) > 0 THEN 'Classes ' || array_to_string(classes[1:3], ', ') || '.' END,
  CASE WHEN len(imports) > 0 THEN 'Uses ' || array_to_string(imports[1:3], ', ') || '.' END) AS summary FROM scan_records WHERE path IS NOT NULL""")
def ref_p29_module_summary(spark: SparkSession, d: str) -> DataFrame:
    told = [F.when(F.size(c) > 0, F.concat(F.lit(f"{w} "), F.array_join(F.slice(c, 1, 3), ", "), F.lit("."))) for c, w in (("functions", "Defines"), ("classes", "Classes"), ("imports", "Uses"))]
    return load(spark, d, "scan_records").filter("path IS NOT NULL").select("csc_id", "path", F.concat_ws(" ", *told).alias("summary")).distinct()


@query("""WITH i AS (SELECT DISTINCT csc_id, target_id FROM graph_edges WHERE edge_type = 'impacts_section' AND target_id IS NOT NULL), n AS (SELECT DISTINCT csc_id, node_id, section_id, label FROM graph_nodes WHERE node_type = 'sdd_section'),
  c AS (SELECT csc_id, section_id, min(text) AS text FROM knowledge_chunks WHERE source_type = 'sdd_section' AND text IS NOT NULL GROUP BY ALL)
  SELECT n.csc_id, n.section_id, n.label, coalesce(c.text, 'TBD') AS existing FROM n SEMI JOIN i ON i.csc_id = n.csc_id AND i.target_id = n.node_id LEFT JOIN c ON c.csc_id = n.csc_id AND c.section_id = n.section_id""")
def ref_j12_impacted_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections that some commit concerns, with the text they have."""
    i = load(spark, d, "graph_edges").filter("edge_type = 'impacts_section' AND target_id IS NOT NULL").select("csc_id", F.col("target_id").alias("node_id")).distinct()
    n = load(spark, d, "graph_nodes").filter("node_type = 'sdd_section'").select("csc_id", "node_id", "section_id", "label").distinct()
    c = load(spark, d, "knowledge_chunks").filter("source_type = 'sdd_section' AND text IS NOT NULL").groupBy("csc_id", "section_id").agg(F.min("text").alias("text"))
    return n.join(i, ["csc_id", "node_id"], "left_semi").join(c, ["csc_id", "section_id"], "left").select("csc_id", "section_id", "label", F.coalesce("text", F.lit("TBD")).alias("existing"))


#: Phrases of release notes, first match counts.
PHRASES = ("since last", "new this quarter", "in this release", "previous version", "changed since", "recent change", "new this checkpoint")
_PHRASE = "CASE " + " ".join(f"WHEN contains(lower(line), '{p}') THEN '{p}'" for p in PHRASES) + " END"
_LEAK = r"\b(?:subsystem|module|interface|context_node)::[A-Za-z0-9_.:/-]+\b"


@query(_HEADS + f""" SELECT doc_id, n AS line_number, 'release_note_phrase' AS check_id, 'warning' AS severity, {_PHRASE} AS reference FROM s WHERE section > 0 AND {_PHRASE} IS NOT NULL
  UNION ALL SELECT doc_id, n, 'contradictory_tbd_phrase', 'warning', trim(line) FROM s WHERE regexp_matches(line, '^\\s*TBD\\s*-\\s*\\S')
  UNION ALL SELECT doc_id, n, 'raw_internal_id_leak', 'error', trim(line) FROM s WHERE regexp_matches(line, '{_LEAK}')""")
def ref_v04_line_rules(spark: SparkSession, d: str) -> DataFrame:
    """Findings of line rules in texts: phrases of release notes behind the first heading, doubtful markers, leaked ids."""
    at = load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode_outer(lines(F.col("text"))).alias("n", "line")).filter("line IS NOT NULL")
    s = at.withColumn("section", F.sum(F.col("line").rlike("^#{1,6} ").cast("int")).over(Window.partitionBy("doc_id").orderBy("n")))
    phrase = F.lit(None).cast("string")
    for p in reversed(PHRASES):
        phrase = F.when(F.lower("line").contains(p), p).otherwise(phrase)
    found = F.array_compact(F.array(
        F.when((F.col("section") > 0) & phrase.isNotNull(), F.struct(F.lit("release_note_phrase").alias("check_id"), F.lit("warning").alias("severity"), phrase.alias("reference"))),
        F.when(F.col("line").rlike(r"^\s*TBD\s*-\s*\S"), F.struct(F.lit("contradictory_tbd_phrase").alias("check_id"), F.lit("warning").alias("severity"), F.trim("line").alias("reference"))),
        F.when(F.col("line").rlike(_LEAK), F.struct(F.lit("raw_internal_id_leak").alias("check_id"), F.lit("error").alias("severity"), F.trim("line").alias("reference")))))
    return s.select("doc_id", (F.col("n") + 1).alias("line_number"), F.explode(found).alias("f")).select("doc_id", "line_number", "f.*")


@query(_HEADS + f", f AS (SELECT doc_id, 'warning' AS severity FROM s WHERE section > 0 AND {_PHRASE} IS NOT NULL UNION ALL SELECT doc_id, 'error' FROM s WHERE regexp_matches(line, '{_LEAK}') UNION ALL SELECT doc_id, 'warning' FROM s WHERE regexp_matches(line, '^\\s*TBD\\s*-\\s*\\S')) SELECT severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM f GROUP BY ALL")
def ref_a26_finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return ref_v04_line_rules(spark, d).groupBy("severity").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents"))
