"""Queries that compose others: answers, documents, proposals, pages, groupings, links and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith import pipelines
from repolith.functions.globs import ignored
from repolith.operators import history, manifests, rendering
from repolith.operators import outline as O
from repolith.operators import repository as P
from repolith.plans import changes, usage
from repolith.plans import outline as plan
from repolith.plans.history import _DELTAS
from repolith.plans.repository import _LANGUAGE, _SUB, _UP
from repolith.plans.retrieval import _WITH, _questions
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tables(spark: SparkSession, d: str) -> pipelines.Tables:
    return pipelines.Tables(*(load(spark, d, t) for t in ("scan_records", "graph_nodes", "graph_edges", "dependency_records", "knowledge_chunks")))


_IGNORE = ["# comment", "*.json", "!**/refresh*.json", "internal/", "/tools/*.txt", "lib/**/flush_*", ""]


@query("""SELECT csc_id, path, CASE WHEN regexp_matches(path, '^lib/(.*/)?flush_[^/]*(/|$)') THEN true WHEN regexp_matches(path, '^tools/[^/]*\\.txt(/|$)') THEN true WHEN regexp_matches(path, '(^|/)internal/') THEN true WHEN regexp_matches(path, '^(.*/)?refresh[^/]*\\.json(/|$)') THEN false ELSE regexp_matches(path, '(^|/)[^/]*\\.json(/|$)') END AS ignored
  FROM (SELECT DISTINCT csc_id, path FROM scan_records WHERE path IS NOT NULL)""")
def ref_s01_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Which files the lines of an ignore file leave out."""
    return load(spark, d, "scan_records").select("csc_id", "path").filter("path IS NOT NULL").distinct().withColumn("ignored", ignored(F.col("path"), _IGNORE))


_QUOTE = "CASE WHEN length(flat) > 200 THEN regexp_replace(substr(flat, 1, 200), '\\s+$', '') || '...' ELSE flat END"


@query(_WITH + f"SELECT t.csc_id, question_id, rank, chunk_id, source_path, line_start, line_end, {_QUOTE} AS quote, CASE WHEN score > 0 THEN 'grounded' ELSE 'insufficient_evidence' END AS status FROM top t JOIN (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS flat FROM chunk) c USING (csc_id, chunk_id)")
def ref_d12_answer_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What every question is answered from, with citations, and whether that is enough."""
    return pipelines.answer_evidence(_tables(spark, d), _questions(spark, d))


@query(_WITH + f""", ev AS (SELECT t.csc_id, question_id, rank, '- ' || source_path || ':' || coalesce(line_start::VARCHAR, '?') || ' ' || {_QUOTE} AS line, CASE WHEN score > 0 THEN 'grounded' ELSE 'insufficient_evidence' END AS status FROM top t JOIN (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS flat FROM chunk) c USING (csc_id, chunk_id))
  SELECT csc_id, question_id, '## Evidence (' || min(status) || ')' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (WHERE line IS NOT NULL) || chr(10) AS markdown FROM ev GROUP BY ALL""")
def ref_v10_answers(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every question as a page."""
    return pipelines.answer_markdown(pipelines.answer_evidence(_tables(spark, d), _questions(spark, d)))


_LISTED = "chr(10) || '## {0}' || chr(10) || chr(10) || CASE WHEN len(coalesce({1}, [])) > 0 THEN '- ' || array_to_string({1}, chr(10) || '- ') ELSE 'None.' END || chr(10)"


@query(f"SELECT DISTINCT csc_id, path, '# ' || path || chr(10) || chr(10) || 'Language: ' || {_LANGUAGE} || chr(10) || {_LISTED.format('Functions', 'functions')} || {_LISTED.format('Classes', 'classes')} || {_LISTED.format('Imports', 'imports')} AS markdown FROM scan_records WHERE path IS NOT NULL")
def ref_v10_file_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for every file."""
    return pipelines.file_markdown(load(spark, d, "scan_records"))


_S = plan.SQL
_LINES = f"""SELECT csc_id, 'introduction' AS section_id, '0' AS place, 'This document describes ' || sum(modules) || ' modules in ' || count(*) || ' subsystems.' AS line FROM (SELECT csc_id, {_SUB} AS subsystem_id, count(DISTINCT path) AS modules FROM scan_records WHERE path IS NOT NULL GROUP BY ALL) GROUP BY csc_id
  UNION ALL SELECT csc_id, 'architectural_overview', subsystem_id, '- `' || display_name || '`' FROM ({_S['ref_v16_subsystem_texts']}) UNION ALL SELECT csc_id, 'subsystems_modules', subsystem_id, '### ' || display_name || chr(10) || chr(10) || summary FROM ({_S['ref_v16_subsystem_texts']})
  UNION ALL SELECT csc_id, 'algorithms_core_logic', capsule_id, '- ' || scope || ' (' || status || ')' FROM ({_S['ref_a19_capsules']}) UNION ALL SELECT csc_id, 'interfaces', interface_id, '- ' || title FROM ({_S['ref_a29_interfaces']})
  UNION ALL SELECT csc_id, 'system_context', node_id, '- ' || title || ': ' || modules || ' modules' FROM ({_S['ref_a29_context_nodes']}) UNION ALL SELECT csc_id, 'build_development_infrastructure', path, '- ' || path || ' (' || ecosystem || ')' FROM ({_S['ref_s21_build_sources']})
  UNION ALL SELECT csc_id, 'design_notes_rationale', lpad(n::VARCHAR, 2, '0'), '- ' || title FROM ({_S['ref_t06_design_notes']})
  UNION ALL SELECT csc_id, 'dependencies', lpad(n::VARCHAR, 2, '0'), '### ' || package || chr(10) || chr(10) || general || chr(10) || chr(10) || "usage" FROM (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY package, coalesce(ecosystem, '')) AS n FROM ({usage.SQL['ref_v13_narratives']}) WHERE section_target = 'dependencies') WHERE n <= 10
  {' '.join(f"UNION ALL SELECT csc_id, '{k}', lpad(n::VARCHAR, 2, '0'), '- `' || path || '`' FROM (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY path) AS n FROM ({_S['ref_f06_token_hits']}) WHERE list_contains(sections, '{k}')) WHERE n <= 10" for k in O.SECTION_TOKENS)}"""


@query(_LINES)
def ref_v07_section_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every section as told without a model."""
    return pipelines.section_lines(_tables(spark, d))


@query(f"SELECT csc_id, count(*) AS sections FROM (SELECT csc_id, section_id FROM ({_S['ref_a20_section_scores']}) WHERE status = 'included' UNION SELECT csc_id, section_id FROM ({_S['ref_a21_context_scores']}) WHERE status = 'included') GROUP BY csc_id")
def ref_d12_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sections read back from the documents that are generated for every repository."""
    documents, _ = pipelines.generate_documents(_tables(spark, d))
    return rendering.bodies(documents, ["csc_id"]).groupBy("csc_id").agg(F.count("*").alias("sections"))


@query("""WITH s AS (SELECT DISTINCT csc_id, section, path, change_kind FROM ({})),
  w AS (SELECT csc_id, section, count(DISTINCT path) AS files, list_sort(list(DISTINCT change_kind)) AS reasons FROM s GROUP BY ALL), h AS (SELECT DISTINCT csc_id, lower(section_id) AS low, true AS had FROM knowledge_chunks WHERE section_id IS NOT NULL)
  SELECT w.csc_id, section, CASE WHEN had THEN 'update' ELSE 'create' END AS status, files, reasons FROM w LEFT JOIN h ON h.csc_id = w.csc_id AND h.low = lower(section)""".replace("{}", changes.SQL["ref_x05_parse_diff"]))
def ref_d12_update_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Sections that changed files concern, to be updated or written anew."""
    titles = load(spark, d, "knowledge_chunks").filter("section_id IS NOT NULL").select("csc_id", F.col("section_id").alias("title"))
    return pipelines.propose_updates(changes._diffs(spark, d), titles)


@query(f"SELECT DISTINCT csc_id, capsule_id, subsystem_id AS concept_id FROM ({_S['ref_a19_capsules']}) c SEMI JOIN (SELECT DISTINCT csc_id, {_SUB} AS subsystem_id FROM scan_records WHERE path IS NOT NULL) m USING (csc_id, subsystem_id) UNION SELECT c.csc_id, capsule_id, 'module::' || scope FROM ({_S['ref_a19_capsules']}) c JOIN (SELECT DISTINCT csc_id, path FROM scan_records) m ON m.csc_id = c.csc_id AND m.path = c.scope WHERE scope_kind = 'file'")
def ref_j16_capsule_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Capsules and the concepts, subsystems and modules, that they overlap."""
    t = _tables(spark, d)
    caps = O.capsules(O.algorithm_candidates(t.edges, t.nodes))
    m = t.scan.select("csc_id", "path").filter("path IS NOT NULL").distinct()
    areas = m.select("csc_id", P.subsystem(F.col("path")).alias("subsystem_id")).distinct()
    return caps.join(areas, ["csc_id", "subsystem_id"], "left_semi").select("csc_id", "capsule_id", F.col("subsystem_id").alias("concept_id")).unionByName(
        caps.filter("scope_kind = 'file'").join(m.withColumnRenamed("path", "scope"), ["csc_id", "scope"], "left_semi").select("csc_id", "capsule_id", F.concat(F.lit("module::"), "scope").alias("concept_id")))


@query(plan._INSIGHTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY t_at, commit_id) AS i, row_number() OVER (PARTITION BY csc_id ORDER BY strength DESC, t_at, commit_id) AS r FROM delta), line AS (SELECT csc_id, greatest(6, min(strength) FILTER (WHERE r <= 3)) AS line, max(strength) AS top FROM r GROUP BY ALL),
  strong AS (SELECT r.* FROM r JOIN line USING (csc_id) WHERE strength >= line OR (top < line AND r = 1)), isl AS (SELECT csc_id, commit_id, i, i - row_number() OVER (PARTITION BY csc_id ORDER BY i) AS island FROM strong), fst AS (SELECT csc_id, island, row_number() OVER (PARTITION BY csc_id ORDER BY min(i)) AS w FROM isl GROUP BY csc_id, island)
  SELECT i.csc_id, insight_id, 'change-window::' || lpad(fst.w::VARCHAR, 2, '0') AS window_id, count(DISTINCT isl.commit_id) AS commits FROM insight i JOIN ch ON ch.csc_id = i.csc_id AND ch.subsystem_id = i.subsystem_id JOIN isl ON isl.csc_id = ch.csc_id AND isl.commit_id = ch.commit_id JOIN fst ON fst.csc_id = isl.csc_id AND fst.island = isl.island WHERE i.kind = 'subsystem_change' GROUP BY ALL""")
def ref_j18_insight_windows(spark: SparkSession, d: str) -> DataFrame:
    """Insights on subsystems and the windows of strong commits that changed them."""
    t = _tables(spark, d)
    strong = history.strong_commits(history.commit_deltas(t.edges, t.dependencies)).select("csc_id", "commit_id", "i", "island")
    first = strong.groupBy("csc_id", "island").agg(F.min("i").alias("first")).withColumn("w", F.row_number().over(Window.partitionBy("csc_id").orderBy("first")))
    told = O.insights(t.edges, t.nodes, t.dependencies).filter("kind = 'subsystem_change'").select("csc_id", "insight_id", "subsystem_id")
    of = O.changed_files(t.edges, t.nodes).select("csc_id", "subsystem_id", "commit_id").distinct()
    j = told.join(of, ["csc_id", "subsystem_id"]).join(strong, ["csc_id", "commit_id"]).join(first.select("csc_id", "island", "w"), ["csc_id", "island"])
    return j.groupBy("csc_id", "insight_id", F.concat(F.lit("change-window::"), F.lpad(F.col("w").cast("string"), 2, "0")).alias("window_id")).agg(F.count_distinct("commit_id").alias("commits"))


_ROLES = f"WITH {plan._hits(plan._ROLE_FLAGS)}, m AS (SELECT csc_id, path, subsystem_id, coalesce(CASE {' '.join(f'WHEN r{i} THEN {k!r}' for i, k in enumerate(O.ROLES))} END, 'other') AS role FROM hit)"


def _memberships(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    hits = O.module_hits(t.scan, t.nodes, plan._ROLE_FLAGS)
    role = F.coalesce(*(F.when(F.col(f"r{i}"), k) for i, k in enumerate(O.ROLES)), F.lit("other"))
    return hits.select("csc_id", "path", "subsystem_id", F.concat(F.lit("semantic::"), role).alias("cluster"))


@query(_ROLES + " SELECT csc_id, path, subsystem_id, 'semantic::' || role AS cluster FROM m")
def ref_j22_membership(spark: SparkSession, d: str) -> DataFrame:
    """The group of each module by path, and its cluster by the role that its own terms tell of."""
    return _memberships(spark, d)


@query(_ROLES + " SELECT csc_id, 'path' AS mode, subsystem_id AS group_id, count(*) AS modules, min(path) AS first_path FROM m GROUP BY ALL UNION ALL SELECT csc_id, 'semantic', 'semantic::' || role, count(*), min(path) FROM m GROUP BY ALL")
def ref_g13_groupings(spark: SparkSession, d: str) -> DataFrame:
    """Two groupings of one schema: by path, and by cluster."""
    m = _memberships(spark, d)
    group = lambda mode, c: m.groupBy("csc_id", F.lit(mode).alias("mode"), F.col(c).alias("group_id")).agg(F.count("*").alias("modules"), F.min("path").alias("first_path"))
    return group("path", "subsystem_id").unionByName(group("semantic", "cluster"))


_AREAS = "ar AS (SELECT csc_id, commit_id, min(area) AS area, count(DISTINCT area) AS areas FROM (SELECT csc_id, commit_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS area FROM f) GROUP BY ALL)"


@query(_DELTAS + f", {_AREAS} SELECT csc_id, commit_id, CASE WHEN list_contains(signals, 'interface') THEN 'Interface boundary shift' WHEN list_has_any(signals, ['infrastructure', 'dependency']) THEN 'Dependency or build milestone' WHEN list_contains(signals, 'architectural') THEN 'Broad structural change' ELSE commit_id END AS title, 'Commit ' || commit_id || ' is retained as a semantic checkpoint candidate because it carries ' || CASE WHEN len(signals) = 0 THEN 'no strong signals' ELSE array_to_string(signals, ', ') END || ' across ' || area || '.' AS rationale FROM delta JOIN ar USING (csc_id, commit_id)")
def ref_p27_title_and_rationale(spark: SparkSession, d: str) -> DataFrame:
    """A title for each commit by the first signal in precedence, and why it may be a checkpoint."""
    t = _tables(spark, d)
    area = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    areas = history.commit_files(t.edges).groupBy("csc_id", "commit_id").agg(F.min(area).alias("area"))
    x = history.commit_deltas(t.edges, t.dependencies).join(areas, ["csc_id", "commit_id"])
    has = lambda *k: F.arrays_overlap("signals", F.array(*map(F.lit, k)))
    title = F.when(has("interface"), "Interface boundary shift").when(has("infrastructure", "dependency"), "Dependency or build milestone").when(has("architectural"), "Broad structural change").otherwise(F.col("commit_id"))
    signals = F.when(F.size("signals") == 0, "no strong signals").otherwise(F.array_join("signals", ", "))
    return x.select("csc_id", "commit_id", title.alias("title"), F.concat(F.lit("Commit "), "commit_id", F.lit(" is retained as a semantic checkpoint candidate because it carries "), signals, F.lit(" across "), "area", F.lit(".")).alias("rationale"))


@query("""WITH known AS (SELECT DISTINCT csc_id, 'file::' || path AS id FROM scan_records WHERE path IS NOT NULL), j AS (SELECT DISTINCT csc_id, source_id AS cluster, target_id AS id FROM graph_edges WHERE edge_type = 'documents' AND target_id LIKE 'file::%'), per AS (SELECT csc_id, id, count(*) AS clusters FROM j GROUP BY ALL)
  SELECT coalesce(k.csc_id, p.csc_id) AS csc_id, count(*) FILTER (WHERE k.id IS NULL) AS unknown, count(*) FILTER (WHERE p.id IS NULL) AS uncovered, count(*) FILTER (WHERE clusters > 1) AS shared, count(*) FILTER (WHERE k.id IS NULL OR p.id IS NULL OR clusters > 1) = 0 AS valid FROM known k FULL JOIN per p ON p.csc_id = k.csc_id AND p.id = k.id GROUP BY ALL""")
def ref_f10_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Sections as clusters of files, checked like a judgment: no unknown file, none left out, none in two."""
    t = _tables(spark, d)
    return O.partition_checks(t.scan, t.edges)


_DECIDED = "decision AS (SELECT csc_id, section_id, bool_or(trim(coalesce(text, '')) <> '') AS wanted FROM knowledge_chunks WHERE section_id IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_DECIDED}, o AS (SELECT * FROM ({_S['ref_a20_section_scores']})), n AS (SELECT csc_id, section_id, row_number() OVER (PARTITION BY csc_id ORDER BY section_id) AS k FROM decision WHERE wanted), top AS (SELECT csc_id, max(k) AS k FROM n GROUP BY ALL) SELECT o.csc_id, o.section_id, o.kind, CASE WHEN o.kind = 'core' THEN 'included' WHEN coalesce(top.k, 0) >= 2 THEN o.status ELSE 'omitted' END AS status, CASE WHEN top.k IS NULL THEN 'heuristic_only' ELSE 'scored' END AS evaluation FROM o LEFT JOIN top USING (csc_id)")
def ref_v17_merged_outline(spark: SparkSession, d: str) -> DataFrame:
    """Outlines after a decision: core sections stay whatever was decided, optional ones only where the document has two written sections; without a decision the heuristic stands."""
    t = _tables(spark, d)
    outline = O.section_scores(t.scan, t.nodes, t.edges, t.dependencies, manifests.build_sources(t.scan))
    written = t.chunks.filter("section_id IS NOT NULL").groupBy("csc_id", "section_id").agg(F.max(F.trim(F.coalesce("text", F.lit(""))) != "").alias("wanted")).filter("wanted").groupBy("csc_id").agg(F.count("*").alias("k"))
    status = F.when(F.col("kind") == "core", "included").when(F.coalesce("k", F.lit(0)) >= 2, F.col("status")).otherwise("omitted")
    return outline.join(written, "csc_id", "left").select("csc_id", "section_id", "kind", status.alias("status"), F.when(F.col("k").isNull(), "heuristic_only").otherwise("scored").alias("evaluation"))


@query("""WITH l AS (SELECT csc_id, edge_type AS kind, target_id AS reference FROM graph_edges WHERE target_id IS NOT NULL UNION SELECT csc_id, 'file', path FROM scan_records WHERE path IS NOT NULL UNION SELECT csc_id, 'dependency', normalized_key FROM dependency_records WHERE normalized_key IS NOT NULL UNION SELECT csc_id, 'section', section_id FROM knowledge_chunks WHERE section_id IS NOT NULL)
  SELECT csc_id, kind, count(*) AS links, min(reference) AS first_reference FROM l GROUP BY ALL""")
def ref_v26_known_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link that a judgment may cite, in numbers by kind."""
    t = _tables(spark, d)
    return O.known_links(t.scan, t.edges, t.dependencies, t.chunks).groupBy("csc_id", "kind").agg(F.count("*").alias("links"), F.min("reference").alias("first_reference"))


@query(f"""WITH f AS (SELECT DISTINCT csc_id, path FROM scan_records WHERE path IS NOT NULL), dr AS (SELECT DISTINCT csc_id, unnest({_UP.format('path')}) AS path FROM f), s AS (SELECT DISTINCT csc_id, metadata['node_id'] AS node_id FROM knowledge_chunks WHERE source_type IN ('file_summary', 'directory_summary') AND metadata['node_id'] IS NOT NULL),
  n AS (SELECT csc_id, 'file' AS kind, 'file::' || path AS node_id, path FROM f UNION ALL SELECT csc_id, 'directory', 'dir::' || path, path FROM dr) SELECT n.csc_id, kind, n.node_id, CASE WHEN s.node_id IS NULL THEN 'rebuilt' ELSE 'reused' END AS origin FROM n LEFT JOIN s ON s.csc_id = n.csc_id AND s.node_id = n.node_id""")
def ref_s25_hierarchy_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the hierarchy store, files and then directories: those that have a summary are reused, the others rebuilt."""
    nodes = P.structure(load(spark, d, "scan_records"))[0].select("csc_id", F.col("node_type").alias("kind"), "node_id")
    s = load(spark, d, "knowledge_chunks").filter("source_type IN ('file_summary', 'directory_summary') AND metadata['node_id'] IS NOT NULL").select("csc_id", F.col("metadata")["node_id"].alias("node_id"), F.lit("reused").alias("origin")).distinct()
    return nodes.join(s, ["csc_id", "node_id"], "left").select("csc_id", "kind", "node_id", F.coalesce("origin", F.lit("rebuilt")).alias("origin"))
