"""Queries on rendered documents and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.text import tokens
from repolith.operators import outline as O
from repolith.operators import rendering
from repolith.operators import validation as V
from repolith.plans.evidence import _SECTIONS, _sections
from repolith.plans.repository import _LINES
from repolith.plans.retrieval import _TOK
from repolith.session import load

QUERIES, SQL = {}, {}
KEYS = ["csc_id"]


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DOCS = _SECTIONS + r""", doc AS (SELECT csc_id, '# ' || csc_id || chr(10) || chr(10) || string_agg('## ' || number || '. ' || title || chr(10) || chr(10) || regexp_replace(body, '(^|\n)(\\*## )', '\1\\\2', 'g'), chr(10) || chr(10) ORDER BY number) || chr(10) AS markdown, count(*) AS sections FROM n GROUP BY csc_id)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return rendering.documents(_sections(spark, d), KEYS)


@query(f"WITH {_DOCS} SELECT * FROM doc")
def ref_v08_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document of each repository from its sections."""
    return _documents(spark, d)


@query(f"WITH {_SECTIONS} SELECT csc_id, number, title, regexp_replace(body, '\\n+$', '') AS body FROM n")
def ref_v09_section_bodies(spark: SparkSession, d: str) -> DataFrame:
    """All sections read back from the written documents."""
    return rendering.bodies(_documents(spark, d), KEYS)


_BLOCKS = _DOCS + f""", ln AS (SELECT csc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM (SELECT csc_id, {_LINES.format('markdown')} AS ls FROM doc)),
  head AS (SELECT csc_id, trim(substr(line, 4)) AS title, n AS at_, row_number() OVER w - 1 AS idx, coalesce(lead(n) OVER w, total + 1) AS until FROM ln WHERE starts_with(line, '## ') WINDOW w AS (PARTITION BY csc_id ORDER BY n))"""
_V1 = _BLOCKS + """, man AS (SELECT csc_id, title AS section_id, number || '. ' || title AS title, number AS position FROM n),
  outl AS (SELECT g.csc_id, g.section_id, coalesce(man.title, g.section_id) AS title, g.status FROM (SELECT csc_id, section_id, CASE WHEN bool_or(removed_at IS NULL) THEN 'included' ELSE 'omitted' END AS status FROM graph_nodes WHERE node_type = 'sdd_section' AND section_id IS NOT NULL GROUP BY ALL) g LEFT JOIN man ON man.csc_id = g.csc_id AND man.section_id = g.section_id),
  last_ AS (SELECT csc_id, title, max(idx) AS md, arg_max(at_, idx) AS line FROM head GROUP BY ALL),
  inc AS (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY section_id) - 1 AS expected FROM outl WHERE status = 'included'), mf AS (SELECT csc_id, section_id, row_number() OVER (PARTITION BY csc_id ORDER BY position) - 1 AS mf FROM man),
  v1 AS (SELECT inc.csc_id, 'included_section_missing' AS check_id, 'error' AS severity, inc.section_id, inc.title AS reference, last_.line AS line_number, 'checkpoint.md' AS artifact FROM inc LEFT JOIN mf ON mf.csc_id = inc.csc_id AND mf.section_id = inc.section_id LEFT JOIN last_ ON last_.csc_id = inc.csc_id AND last_.title = inc.title WHERE mf IS DISTINCT FROM expected OR md IS DISTINCT FROM expected
    UNION ALL SELECT o.csc_id, 'omitted_section_rendered', 'error', o.section_id, o.title, NULL, 'checkpoint.md' FROM outl o SEMI JOIN last_ ON last_.csc_id = o.csc_id AND last_.title = o.title WHERE status = 'omitted'
    UNION ALL SELECT a.csc_id, 'render_manifest_mismatch', 'error', NULL, coalesce(array_to_string(b.t, ' -> '), ''), NULL, 'render_manifest.json' FROM (SELECT csc_id, list(title ORDER BY position) AS t FROM man GROUP BY ALL) a LEFT JOIN (SELECT csc_id, list(title ORDER BY idx) AS t FROM head GROUP BY ALL) b USING (csc_id) WHERE a.t IS DISTINCT FROM b.t)"""


def _section_findings(spark: SparkSession, d: str) -> DataFrame:
    man = rendering.numbered(_sections(spark, d), KEYS).select("csc_id", F.col("title").alias("section_id"), F.concat("number", F.lit(". "), "title").alias("title"), F.col("number").alias("position"))
    nodes = load(spark, d, "graph_nodes").filter("node_type = 'sdd_section' AND section_id IS NOT NULL").groupBy("csc_id", "section_id").agg(F.when(F.max(F.col("removed_at").isNull()), "included").otherwise("omitted").alias("status"))
    outline = nodes.join(man.select("csc_id", "section_id", "title"), ["csc_id", "section_id"], "left").select("csc_id", "section_id", F.coalesce("title", "section_id").alias("title"), "status", F.col("section_id").alias("position"))
    return V.section_findings(outline, man, _documents(spark, d), KEYS)


@query(f"WITH {_V1} SELECT * FROM v1")
def ref_v01_section_checks(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the graph against the rendered documents: missing, out of order, rendered although removed."""
    return _section_findings(spark, d)


_V3 = r""", inner_ AS (SELECT h.csc_id, h.title AS section_id, h.until AS s_until, l.n AS at_, trim(substr(l.line, 5)) AS title FROM head h JOIN ln l ON l.csc_id = h.csc_id AND l.n > h.at_ AND l.n < h.until AND starts_with(l.line, '### ')),
  sub AS (SELECT *, coalesce(lead(at_) OVER (PARTITION BY csc_id, section_id, s_until ORDER BY at_), s_until) AS until, count(*) OVER (PARTITION BY csc_id, section_id, title) AS times FROM inner_),
  sb AS (SELECT s.csc_id, s.section_id, s.title, s.at_, s.times, coalesce(string_agg(trim(l.line, ' '), chr(10) ORDER BY l.n), '') AS body, count(*) FILTER (WHERE starts_with(trim(l.line, ' '), '- ')) AS bullets, min(trim(l.line, ' ')) FILTER (WHERE starts_with(trim(l.line, ' '), '- ')) AS bullet FROM sub s LEFT JOIN ln l ON l.csc_id = s.csc_id AND l.n > s.at_ AND l.n < s.until GROUP BY ALL),
  sp AS (SELECT *, CASE WHEN b = '' THEN [] ELSE list_transform(string_split_regex(b, '\n\n+'), lambda x: replace(x, chr(10), ' ')) END AS ps FROM (SELECT *, regexp_replace(body, '^\n+|\n+$', '', 'g') AS b FROM sb)),
  v3 AS (SELECT DISTINCT csc_id, 'dependency_subsection_shape_invalid' AS check_id, 'error' AS severity, section_id, title AS reference, NULL::BIGINT AS line_number, 'checkpoint.md' AS artifact FROM sp WHERE times > 1
    UNION ALL SELECT csc_id, 'dependency_subsection_shape_invalid', 'error', section_id, title, at_, 'checkpoint.md' FROM sp WHERE times = 1 AND (bullets > 0 OR len(ps) <> 2)
    UNION ALL SELECT csc_id, 'dependency_summary_tbd', 'warning', section_id, title, at_, 'checkpoint.md' FROM sp WHERE times = 1 AND bullets = 0 AND len(ps) = 2 AND list_contains(ps, 'TBD')
    UNION ALL SELECT csc_id, 'algorithm_capsule_thin', 'warning', section_id, title, at_, 'checkpoint.md' FROM sp WHERE times = 1 AND bullets = 1 AND starts_with(bullet, '- Scope:'))"""


@query(f"WITH {_BLOCKS}{_V3} SELECT * FROM v3")
def ref_v03_subsection_checks(spark: SparkSession, d: str) -> DataFrame:
    """Subsections that stand twice, have bullets or not two paragraphs, hold `TBD`, or only a scope bullet (also V5)."""
    return V.subsection_findings(_documents(spark, d), KEYS)


_PHRASE = "CASE " + " ".join(f"WHEN contains(lower(line), '{p}') THEN '{p}'" for p in V.PHRASES) + " END"
_V4 = f""", v4 AS (SELECT ln.csc_id, 'release_note_phrase' AS check_id, 'warning' AS severity, NULL AS section_id, {_PHRASE} AS reference, n::BIGINT AS line_number, 'checkpoint.md' AS artifact FROM ln JOIN (SELECT csc_id, min(at_) AS b FROM head GROUP BY ALL) f ON f.csc_id = ln.csc_id AND n >= b WHERE {_PHRASE} IS NOT NULL
    UNION ALL SELECT csc_id, 'raw_internal_id_leak', 'error', NULL, trim(line, ' '), n, 'checkpoint.md' FROM ln WHERE regexp_matches(line, '{V.LEAKED_ID}') UNION ALL SELECT csc_id, 'contradictory_tbd_phrase', 'warning', NULL, trim(line, ' '), n, 'checkpoint.md' FROM ln WHERE regexp_matches(line, '{V.CONTRADICTORY}')
    UNION ALL SELECT h.csc_id, CASE WHEN regexp_matches(h.title, '^[0-9]+\\. {O.CORE[0]}$') THEN 'weak_core_section' ELSE 'weak_optional_section' END, CASE WHEN regexp_matches(h.title, '^[0-9]+\\. {O.CORE[0]}$') THEN 'error' ELSE 'warning' END, h.title, trim(l.line, ' '), l.n, 'checkpoint.md' FROM head h JOIN ln l ON l.csc_id = h.csc_id AND l.n > h.at_ AND l.n < h.until WHERE trim(l.line, ' ') IN ({', '.join(f"'{x}'" for x in V.FILLERS)}))"""
_ALL = f"WITH {_V1}{_V3}{_V4}, every AS (SELECT * FROM v1 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4)"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return _section_findings(spark, d).unionByName(V.subsection_findings(docs, KEYS)).unionByName(V.line_findings(docs, KEYS))


@query(_ALL + " SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY severity, check_id, coalesce(section_id, ''), coalesce(reference, ''), coalesce(line_number, 0), coalesce(artifact, '')) AS place, bool_or(severity = 'error') OVER (PARTITION BY csc_id) AS aborts FROM every")
def ref_v06_finding_order(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the rendered documents in canonical order, and whether a render is given up."""
    return V.ordered(_findings(spark, d), KEYS)


@query(_ALL + ", m AS (SELECT csc_id, section_id, arg_min(check_id, severity || check_id) AS check_id, min(severity) AS severity FROM every WHERE section_id IS NOT NULL GROUP BY ALL) SELECT csc_id, section_id, severity, check_id, n FROM (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY severity, check_id, section_id) AS n FROM m) WHERE n <= 4")
def ref_w09_repair_sections(spark: SparkSession, d: str) -> DataFrame:
    """At most four sections of each document to be repaired first: by their worst finding, then by name."""
    m = _findings(spark, d).filter("section_id IS NOT NULL").groupBy("csc_id", "section_id").agg(F.min(F.struct("severity", "check_id")).alias("w")).select("csc_id", "section_id", "w.severity", "w.check_id")
    return O.capped(m, ["csc_id"], [F.col("severity"), F.col("check_id"), F.col("section_id")], 4)


@query("SELECT DISTINCT csc_id, path, list_filter(functions, lambda x, i: list_position(functions, x) = i)[:12] AS files, list_filter(list_transform(coalesce(docstrings, []), lambda x: trim(x, ' ')), lambda x: x <> '')[:6] AS topics FROM (SELECT csc_id, path, coalesce(functions, []) AS functions, list_filter(docstrings, lambda x, i: list_position(docstrings, x) = i) AS docstrings FROM scan_records WHERE path IS NOT NULL)")
def ref_t07_capped_lists(spark: SparkSession, d: str) -> DataFrame:
    """The distinct names of each file in their order, at most twelve, and the topics that are not blank, at most six."""
    empty = F.array().cast("array<string>")
    topics = F.filter(F.transform(F.array_distinct(F.coalesce("docstrings", empty)), F.trim), lambda x: x != "")
    return load(spark, d, "scan_records").filter("path IS NOT NULL").select("csc_id", "path", F.slice(F.array_distinct(F.coalesce("functions", empty)), 1, 12).alias("files"), F.slice(topics, 1, 6).alias("topics")).distinct()


@query(f"SELECT DISTINCT csc_id, CASE source_type WHEN 'sdd_section' THEN 'document' ELSE 'review' END AS family, source_type || '::' || coalesce(section_id, chunk_id) AS id, text, len({_TOK.format('text')}) AS tokens FROM knowledge_chunks WHERE source_type IN ('sdd_section', 'review_artifact') AND trim(text, ' ') <> ''")
def ref_v12_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents and reviews with their whole text; blank ones are none."""
    c = load(spark, d, "knowledge_chunks").filter("source_type IN ('sdd_section', 'review_artifact') AND trim(text) <> ''")
    return c.select("csc_id", F.when(F.col("source_type") == "sdd_section", "document").otherwise("review").alias("family"), F.concat("source_type", F.lit("::"), F.coalesce("section_id", "chunk_id")).alias("id"), "text", F.size(tokens(F.col("text"))).alias("tokens")).distinct()
