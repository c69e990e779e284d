"""Queries on sections, interfaces, candidates, capsules and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators import manifests
from repolith.operators import outline as O
from repolith.plans.history import _DELTAS, _NORMAL
from repolith.plans.repository import _LINES, _SUB
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [load(spark, d, {"scan": "scan_records", "nodes": "graph_nodes", "edges": "graph_edges", "deps": "dependency_records"}[n]) for n in names]


def _has(words: tuple[str, ...], what: str = "terms") -> str:
    return f"regexp_matches({what}, '{'|'.join(words)}')"


def _hits(lists: dict[str, tuple[str, ...]]) -> str:
    """Common table hit: one row a module with a flag for each list."""
    return f"""row_ AS (SELECT csc_id, path, lower(concat_ws(chr(10), path, array_to_string(functions, chr(10)), array_to_string(classes, chr(10)), array_to_string(imports, chr(10)), array_to_string(docstrings, chr(10)))) AS terms, true AS scanned FROM scan_records WHERE path IS NOT NULL
    UNION ALL SELECT csc_id, path, lower(coalesce(qualified_name, symbol_name)), false FROM graph_nodes WHERE node_type = 'symbol' AND path IS NOT NULL AND symbol_name IS NOT NULL),
  hit AS (SELECT csc_id, path, {_SUB} AS subsystem_id, {', '.join(f'bool_or({_has(w)}) AS {k}' for k, w in lists.items())} FROM row_ GROUP BY csc_id, path HAVING bool_or(scanned))"""


@query(f"WITH {_hits(O.SECTION_TOKENS)} SELECT csc_id, path, list_filter([{', '.join(f'''CASE WHEN {k} THEN '{k}' END''' for k in O.SECTION_TOKENS)}], lambda x: x IS NOT NULL) AS sections FROM hit WHERE {' OR '.join(O.SECTION_TOKENS)}")
def ref_f06_token_hits(spark: SparkSession, d: str) -> DataFrame:
    """Sections that a module belongs to by the words in its terms."""
    hits = O.module_hits(*_tables(spark, d, "scan", "nodes"), O.SECTION_TOKENS)
    return hits.select("csc_id", "path", F.array_compact(F.array(*(F.when(F.col(k), k) for k in O.SECTION_TOKENS))).alias("sections")).filter(F.size("sections") > 0)


_STEM = "regexp_replace(regexp_extract({0}, '([^/]+)$', 1), '(.)\\.[^.]*$', '\\1')"
_KIND = "CASE WHEN http_api THEN 'http_api' WHEN cli_surface THEN 'cli_surface' WHEN data_contract THEN 'data_contract' WHEN library_surface OR regexp_matches(path, '(^|/)__init__\\.py$') THEN 'library_surface' END"
_FACES = f"""{_hits(O.INTERFACE_TOKENS)}, kinds AS (SELECT csc_id, path, subsystem_id, {_KIND} AS kind FROM hit), face AS (SELECT csc_id, path, subsystem_id, kind,
    CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in O.INTERFACE_TITLES.items())} END || ': ' || array_to_string(list_transform(string_split(replace({_STEM.format('path')}, '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title,
    'interface::' || kind || '::' || regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS interface_id FROM kinds WHERE kind IS NOT NULL)"""


@query(f"WITH {_FACES} SELECT * FROM face")
def ref_a29_interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Modules that show an interface, by the first kind whose words occur in their terms."""
    return O.interface_kinds(*_tables(spark, d, "scan", "nodes"))


_CONTEXT = _hits({"stores": O.STORE_TOKENS}) + """, context AS (SELECT csc_id, 'context-node::system' AS node_id, 'system' AS kind, csc_id || ' System' AS title, count(*) AS modules, count(DISTINCT subsystem_id) AS subsystems FROM hit GROUP BY csc_id
  UNION ALL SELECT csc_id, 'context-node::data-store', 'data_store', 'Data Stores', count(*), count(DISTINCT subsystem_id) FROM hit WHERE stores GROUP BY csc_id)"""


@query(f"WITH {_CONTEXT} SELECT * FROM context")
def ref_a29_context_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The system of each repository and its data stores."""
    return O.context_nodes(*_tables(spark, d, "scan", "nodes"))


@query(f"""WITH faces AS (WITH {_FACES} SELECT csc_id, count(*) AS n FROM face GROUP BY ALL), nodes_ AS (WITH {_CONTEXT} SELECT csc_id, count(*) FILTER (WHERE kind <> 'system') AS others, max(subsystems) FILTER (WHERE kind = 'system') AS subsystems FROM context GROUP BY ALL),
  a AS (SELECT c.csc_id, others, subsystems, coalesce(n, 0) AS n FROM nodes_ c LEFT JOIN faces USING (csc_id)),
  t AS (SELECT csc_id, 'system_context' AS section_id, 4 + least(others, 2) + (subsystems >= 2)::INT + (n > 0)::INT AS score, others > 0 OR subsystems >= 2 AS inside FROM a UNION ALL SELECT csc_id, 'interfaces', 4 + least(n, 3) + (n > 0)::INT, n > 0 FROM a)
  SELECT csc_id, section_id, CASE WHEN inside THEN 'included' ELSE 'omitted' END AS status, score, CASE WHEN inside THEN CASE WHEN score <= 6 THEN 'brief' WHEN score <= 8 THEN 'standard' ELSE 'deep' END END AS depth FROM t""")
def ref_a21_context_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the sections on the system's context and on interfaces."""
    return O.context_scores(*_tables(spark, d, "scan", "nodes"))


_PRECEDENCE = "list_position(['introduced', 'retired', 'modified', 'observed', 'unchanged'], status)"
_FILE_NODE = _NORMAL.replace("source_id", "node_id")
_CHANGED = _DELTAS + f""", begin_ AS (SELECT csc_id, min(t_at) AS t0 FROM f GROUP BY csc_id), span AS (SELECT csc_id, {_FILE_NODE} AS path, min(recorded_at) AS first_at, bool_and(removed_at IS NOT NULL) AS gone FROM graph_nodes WHERE node_type = 'file' GROUP BY ALL),
  ch AS (SELECT f.csc_id, f.commit_id, f.path, t0, CASE WHEN coalesce(gone, false) THEN 'retired' WHEN first_at > t0 THEN 'introduced' ELSE 'modified' END AS status, {_SUB.replace('path', 'f.path')} AS subsystem_id FROM f JOIN begin_ USING (csc_id) LEFT JOIN span s ON s.csc_id = f.csc_id AND s.path = f.path),
  nm AS (SELECT c.csc_id, c.path, count(DISTINCT symbol_name) AS names, count(DISTINCT CASE WHEN n.recorded_at > t0 OR n.removed_at IS NOT NULL THEN symbol_name END) AS changed FROM (SELECT DISTINCT csc_id, path, t0 FROM ch) c JOIN graph_nodes n ON n.csc_id = c.csc_id AND n.path = c.path AND n.node_type = 'symbol' AND n.symbol_name IS NOT NULL GROUP BY ALL),
  pf AS (SELECT ch.csc_id, ch.path, subsystem_id, status, count(DISTINCT commit_id) AS commits, coalesce(max(names), 0) AS names, coalesce(max(changed), 0) AS changed, {_STEM.format('lower(ch.path)')} AS stem FROM ch LEFT JOIN nm ON nm.csc_id = ch.csc_id AND nm.path = ch.path GROUP BY ch.csc_id, ch.path, subsystem_id, status),
  ps AS (SELECT csc_id, subsystem_id, arg_min(status, {_PRECEDENCE}) AS status, sum(names)::BIGINT AS names, sum(changed)::BIGINT AS changed, count(DISTINCT CASE WHEN regexp_matches(stem, 'strategy|variant|policy|mode|backend|adapter') THEN stem END) AS variants FROM pf GROUP BY ALL),
  psc AS (SELECT csc_id, subsystem_id, count(DISTINCT commit_id) AS commits, count(DISTINCT path) AS files FROM ch GROUP BY ALL),
  cand AS (SELECT * FROM (SELECT csc_id, 'algorithm::file::' || path AS candidate_id, 'file' AS scope_kind, path AS scope, subsystem_id, list_filter([CASE WHEN status = 'introduced' AND names >= 2 THEN 'introduced_module' END, CASE WHEN changed >= 2 THEN 'multi_symbol' END], lambda x: x IS NOT NULL) AS signals, commits, changed, 0 AS variants FROM pf
    UNION ALL SELECT ps.csc_id, 'algorithm::subsystem::' || subsystem_id, 'subsystem', subsystem_id, subsystem_id, list_filter([CASE WHEN status = 'introduced' AND names >= 2 THEN 'introduced_module' END, CASE WHEN variants >= 2 THEN 'variant_family' END], lambda x: x IS NOT NULL), psc.commits, changed, variants FROM ps JOIN psc USING (csc_id, subsystem_id)) WHERE len(signals) > 0)"""


@query(_CHANGED + " SELECT * FROM cand")
def ref_a10_algorithm_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files and subsystems that may hold an algorithm, by four rules."""
    return O.algorithm_candidates(*_tables(spark, d, "edges", "nodes"))


_CAPSULES = _CHANGED + """, seed AS (SELECT DISTINCT csc_id, subsystem_id, true AS seeded FROM cand WHERE scope_kind = 'subsystem'), known AS (SELECT cand.*, coalesce(seeded, false) AS whole FROM cand LEFT JOIN seed USING (csc_id, subsystem_id)),
  taken AS (SELECT * FROM known WHERE whole OR len(signals) = 2 AND scope_kind = 'file' OR changed >= 3),
  gcap AS (SELECT csc_id, CASE WHEN whole THEN 'subsystem' ELSE 'file' END AS kind, CASE WHEN whole THEN subsystem_id ELSE scope END AS at_, subsystem_id, count(*) AS candidates, list_sort(list_distinct(flatten(list(signals)))) AS signals, max(CASE WHEN (scope_kind = 'subsystem') = whole THEN changed END) AS changed, max(variants) AS variants FROM taken GROUP BY ALL),
  cap AS (SELECT csc_id, 'algorithm-capsule::' || kind || '::' || at_ AS capsule_id, kind AS scope_kind, at_ AS scope, subsystem_id, CASE WHEN list_contains(signals, 'introduced_module') THEN 'introduced' ELSE 'modified' END AS status, candidates, signals, changed, variants FROM gcap)"""


@query(_CAPSULES + " SELECT * FROM cap")
def ref_a19_capsules(spark: SparkSession, d: str) -> DataFrame:
    """Capsules of algorithms: subsystems with their files, and files that stand alone."""
    return O.capsules(O.algorithm_candidates(*_tables(spark, d, "edges", "nodes")))


@query(f"""WITH n AS (SELECT csc_id, {_SUB} AS subsystem_id, unnest(classes) AS name, 'class' AS kind FROM scan_records WHERE path IS NOT NULL UNION ALL SELECT csc_id, {_SUB}, symbol_name, 'symbol' FROM graph_nodes WHERE node_type = 'symbol' AND path IS NOT NULL),
  g AS (SELECT csc_id, subsystem_id, name, min(kind) AS kind FROM n WHERE {_has(O.STRUCTURE_TOKENS, 'lower(name)')} GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY csc_id, subsystem_id ORDER BY lower(name), name) AS n FROM g) WHERE n <= 6""")
def ref_a18_data_structures(spark: SparkSession, d: str) -> DataFrame:
    """Up to six data structures of each subsystem by name."""
    return O.data_structures(*_tables(spark, d, "scan", "nodes"))


@query(f"""WITH s AS (SELECT csc_id, {_SUB} AS subsystem_id, unnest({_LINES.format('doc')}) AS line FROM (SELECT csc_id, path, unnest(docstrings) AS doc FROM scan_records WHERE path IS NOT NULL)),
  t AS (SELECT DISTINCT csc_id, subsystem_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM s)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY csc_id, subsystem_id ORDER BY lower(text), text) AS n FROM t WHERE text <> '' AND {_has(O.ASSUMPTION_TOKENS, 'lower(text)')}) WHERE n <= 5""")
def ref_a18_assumptions(spark: SparkSession, d: str) -> DataFrame:
    """Up to five assumptions that each subsystem's documentation states."""
    return O.assumptions(load(spark, d, "scan_records"))



_MANIFEST = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{e}', '{c}')" for n, (e, c) in manifests.BUILD_SOURCES.items()) + ") AS v(name, ecosystem, category))"
_SOURCES = f"""{_MANIFEST}, at_ AS (SELECT DISTINCT csc_id, path, regexp_extract(path, '([^/]+)$', 1) AS name FROM scan_records WHERE path IS NOT NULL AND length(path) - length(replace(path, '/', '')) <= 1),
  source_ AS (SELECT csc_id, path, CASE WHEN m.name IS NOT NULL THEN m.ecosystem WHEN ends_with(at_.name, '.csproj') THEN 'dotnet' ELSE 'python' END AS ecosystem, coalesce(m.category, 'dependency_manifest') AS category
    FROM at_ LEFT JOIN m ON m.name = at_.name WHERE m.name IS NOT NULL OR regexp_matches(at_.name, '^requirements-.*\\.txt$|\\.csproj$'))"""


@query(f"WITH {_SOURCES} SELECT * FROM source_")
def ref_s21_build_sources(spark: SparkSession, d: str) -> DataFrame:
    """Build manifests at the top of each repository and of its source roots, with their ecosystem and category."""
    return manifests.build_sources(load(spark, d, "scan_records"))


@query()
def ref_x06_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Declarations and warnings of all manifests among the scanned files."""
    return manifests.declarations(load(spark, d, "scan_records"))


_T = O.SECTION_TOKENS
_SCORES = _CHANGED + f""", {_hits(_T)}, {_SOURCES},
  base AS (SELECT csc_id, count(*) AS modules, count(DISTINCT subsystem_id) AS subsystems, {', '.join(f"count(*) FILTER (WHERE {k}) AS {k}, count(DISTINCT CASE WHEN {k} THEN subsystem_id END) AS {k}_areas" for k in _T)} FROM hit GROUP BY csc_id),
  deps_ AS (SELECT csc_id, count(DISTINCT normalized_key) AS deps, max(recorded_at) AS last_at FROM dependency_records GROUP BY csc_id), infra_ AS (SELECT csc_id, count(DISTINCT path) AS infra FROM source_ GROUP BY csc_id),
  com AS (SELECT csc_id, bool_or(list_contains(signals, 'architectural')) AS arch, bool_or(list_has_any(signals, ['architectural', 'interface'])) AS shape, bool_or(list_contains(signals, 'dependency')) AS dep, bool_or(list_contains(signals, 'infrastructure')) AS inf, count(*) FILTER (WHERE list_has_any(signals, ['architectural', 'interface', 'dependency'])) AS rationale FROM delta GROUP BY csc_id),
  lives AS (SELECT csc_id, min(t0) AS t0, bool_or(status = 'introduced')::INT AS is_, bool_or(status = 'introduced' AND regexp_matches(path, '\\.(h|hpp|ts)$'))::INT AS ii, bool_or(status = 'retired')::INT AS rs, bool_or(status = 'retired' AND regexp_matches(path, '\\.(h|hpp|ts)$'))::INT AS ri FROM ch GROUP BY csc_id),
  rob AS (SELECT c.csc_id, count(DISTINCT c.path) AS robust FROM ch c SEMI JOIN (SELECT csc_id, path FROM graph_nodes WHERE node_type = 'symbol' AND {_has(_T['error_handling_robustness'], 'lower(coalesce(qualified_name, symbol_name))')}) n ON n.csc_id = c.csc_id AND n.path = c.path WHERE regexp_matches(c.path, '\\.(h|hpp|ts)$') GROUP BY c.csc_id),
  fam AS (SELECT csc_id, count(*) AS families FROM cand WHERE list_contains(signals, 'variant_family') GROUP BY csc_id),
  a AS (SELECT base.*, coalesce(deps, 0) AS deps, last_at, coalesce(infra, 0) AS infra, coalesce(arch, false)::INT AS arch, coalesce(shape, false)::INT AS shape, coalesce(dep, false)::INT AS dep, coalesce(inf, false)::INT AS inf, coalesce(rationale, 0) AS rationale, t0, is_, ii, rs, ri, coalesce(robust, 0) AS robust, coalesce(families, 0) AS families
    FROM base LEFT JOIN deps_ USING (csc_id) LEFT JOIN infra_ USING (csc_id) LEFT JOIN com USING (csc_id) LEFT JOIN lives USING (csc_id) LEFT JOIN rob USING (csc_id) LEFT JOIN fam USING (csc_id)),
  t AS (SELECT csc_id, 'introduction' AS section_id, 'core' AS kind, 10 AS score, 2 AS links FROM a UNION ALL SELECT csc_id, 'architectural_overview', 'core', 4 + least(subsystems, 3) + arch + (subsystems >= 2)::INT, 2 FROM a
    UNION ALL SELECT csc_id, 'subsystems_modules', 'core', 4 + least(subsystems, 2) + least(modules // 2, 3) + shape, 2 FROM a UNION ALL SELECT csc_id, 'dependencies', 'core', 4 + least(deps, 3) + dep, 2 FROM a UNION ALL SELECT csc_id, 'build_development_infrastructure', 'core', 4 + least(infra, 3) + inf, 2 FROM a
    {' '.join(f"UNION ALL SELECT csc_id, '{k}', 'optional', least({k} * 2, 6), {k} + {k}_areas FROM a" for k in _T if k != 'error_handling_robustness')}
    UNION ALL SELECT csc_id, 'error_handling_robustness', 'optional', least(error_handling_robustness * 2, 6) + least(robust, 2), error_handling_robustness + error_handling_robustness_areas + robust FROM a
    UNION ALL SELECT csc_id, 'strategy_variants_design_alternatives', 'optional', CASE WHEN families > 0 THEN 6 ELSE 0 END, families * 2 FROM a
    UNION ALL SELECT csc_id, 'design_notes_rationale', 'optional', least(rationale * 2, 6) + CASE WHEN t0 IS NULL THEN 0 ELSE least(is_ + ii + coalesce(last_at > t0, false)::INT, 2) + least(rs + ri, 2) END, rationale * 2 FROM a),
  u AS (SELECT *, kind = 'core' OR score >= 5 AND links >= 2 AS inside FROM t),
  outline AS (SELECT csc_id, section_id, kind, CASE WHEN inside THEN 'included' ELSE 'omitted' END AS status, score::BIGINT AS score, CASE kind WHEN 'core' THEN greatest(60, least(100, score * 10)) ELSE least(100, score * 10) END::BIGINT AS confidence,
    CASE WHEN section_id = 'introduction' THEN 'brief' WHEN kind = 'core' THEN CASE WHEN score <= 5 THEN 'brief' WHEN score <= 7 THEN 'standard' ELSE 'deep' END WHEN inside THEN CASE WHEN score <= 6 THEN 'brief' WHEN score <= 8 THEN 'standard' ELSE 'deep' END END AS depth FROM u)"""


def _outline(spark: SparkSession, d: str) -> DataFrame:
    scan, nodes, edges, deps = _tables(spark, d, "scan", "nodes", "edges", "deps")
    return O.section_scores(scan, nodes, edges, deps, manifests.build_sources(scan))


@query(_SCORES + " SELECT * FROM outline")
def ref_a20_section_scores(spark: SparkSession, d: str) -> DataFrame:
    """The outline of each repository's document: five core and seven optional sections with their scores."""
    return _outline(spark, d)


_INSIGHTS = _CHANGED + """, raw_ AS (SELECT csc_id, subsystem_id AS change_id, 'subsystem_change' AS kind, 'Subsystem ' || status || ': ' || regexp_replace(subsystem_id, '^subsystem::', '') AS title, subsystem_id, commits + files AS score FROM ps JOIN psc USING (csc_id, subsystem_id)
    UNION ALL SELECT csc_id, 'interface::' || path, 'interface_change', 'Interface ' || status || ': ' || path, NULL, commits FROM pf WHERE regexp_matches(path, '\\.(h|hpp|ts)$')
    UNION ALL SELECT csc_id, 'dependency::' || path, 'dependency_change', 'Dependency Change: ' || path, subsystem_id, commits + 1 FROM pf SEMI JOIN dep USING (csc_id, path)
    UNION ALL SELECT csc_id, candidate_id, 'algorithm_change', 'Algorithm signal: ' || scope, subsystem_id, commits + changed + variants FROM cand),
  ins AS (SELECT csc_id, 'interval-insight::' || regexp_replace(regexp_replace(lower(change_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS insight_id, kind, title, subsystem_id, CASE WHEN score >= 10 THEN 'high' WHEN score >= 6 THEN 'medium' ELSE 'low' END AS significance, change_id FROM raw_),
  insight AS (SELECT * EXCLUDE (change_id) FROM (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY kind, title, insight_id, change_id) AS n FROM ins) WHERE n <= 12)"""


def _insights(spark: SparkSession, d: str) -> DataFrame:
    return O.insights(*_tables(spark, d, "edges", "nodes", "deps"))


@query(_INSIGHTS + " SELECT * FROM insight")
def ref_t06_insights(spark: SparkSession, d: str) -> DataFrame:
    """Up to twelve insights of each repository's interval."""
    return _insights(spark, d)


_NOTES = _INSIGHTS + ", note AS (SELECT csc_id, 'design-note::' || insight_id AS note_id, title, subsystem_id, n FROM (SELECT csc_id, insight_id, title, subsystem_id, row_number() OVER (PARTITION BY csc_id ORDER BY CASE significance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, insight_id DESC, title DESC) AS n FROM insight) WHERE n <= 8 AND subsystem_id IS NOT NULL)"


@query(_NOTES + " SELECT * FROM note")
def ref_t06_design_notes(spark: SparkSession, d: str) -> DataFrame:
    """Design notes from up to eight insights of each repository."""
    return O.design_notes(_insights(spark, d))


_REMARK = "CASE " + " ".join(f"WHEN {_has(w, 'lower(text)')} THEN '{k}'" for k, w in O.REMARKS.items()) + " END"


@query(f"SELECT DISTINCT csc_id, chunk_id, {_REMARK} AS section_id, CASE WHEN {_REMARK} IS NULL THEN 'unrepairable' ELSE 'repair' END AS outcome FROM knowledge_chunks WHERE source_type = 'review_artifact' AND text IS NOT NULL")
def ref_v18_review_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section that each review is about, by the first list of words that it has one of; a review without one can't be repaired."""
    section = O.first_list(F.lower("text"), O.REMARKS)
    r = load(spark, d, "knowledge_chunks").filter("source_type = 'review_artifact' AND text IS NOT NULL").select("csc_id", "chunk_id", section.alias("section_id"))
    return r.withColumn("outcome", F.when(F.col("section_id").isNull(), "unrepairable").otherwise("repair")).distinct()


_ROLE_FLAGS = {f"r{i}": w for i, w in enumerate(O.ROLES.values())}
_ROLE_CASES = " ".join(f"WHEN bool_or(r{i}) THEN '{k}'" for i, k in enumerate(O.ROLES))


@query(f"WITH {_hits(_ROLE_FLAGS)} SELECT csc_id, subsystem_id, CASE {_ROLE_CASES} END AS role, count(*) AS modules FROM hit GROUP BY ALL")
def ref_v19_role_hints(spark: SparkSession, d: str) -> DataFrame:
    """The role of each subsystem by the words in its modules' terms, the first role that fits."""
    hits = O.module_hits(*_tables(spark, d, "scan", "nodes"), _ROLE_FLAGS)
    g = hits.groupBy("csc_id", "subsystem_id").agg(F.count("*").alias("modules"), *(F.max(k).alias(k) for k in _ROLE_FLAGS))
    return g.select("csc_id", "subsystem_id", F.coalesce(*(F.when(F.col(f"r{i}"), k) for i, k in enumerate(O.ROLES))).alias("role"), "modules")


_INVENTORY = f"WITH {_FACES}, by_kind AS (SELECT csc_id, kind, subsystem_id, min(interface_id) AS interface_id, count(*) AS modules FROM face GROUP BY ALL)"


@query(_INVENTORY + " SELECT csc_id, interface_id, kind, subsystem_id, modules, 'Boundary Responsibility' AS responsibility, CASE WHEN modules > 1 THEN 'contract::' || interface_id END AS contract_id, greatest(modules - 1, 0) AS consumers FROM by_kind")
def ref_v14_interface_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The inventory without a model: an entry for each kind of interface of a subsystem, with a contract where several modules take part."""
    faces = O.interface_kinds(*_tables(spark, d, "scan", "nodes")).groupBy("csc_id", "kind", "subsystem_id").agg(F.min("interface_id").alias("interface_id"), F.count("*").alias("modules"))
    return faces.select("csc_id", "interface_id", "kind", "subsystem_id", "modules", F.lit("Boundary Responsibility").alias("responsibility"), F.when(F.col("modules") > 1, F.concat(F.lit("contract::"), "interface_id")).alias("contract_id"), F.greatest(F.col("modules") - 1, F.lit(0)).alias("consumers"))


@query(_CAPSULES + f""", phase AS (SELECT csc_id, subsystem_id, list_sort(list_distinct(list(struct_pack(i := i, p := p)))) AS ph FROM (SELECT csc_id, {_SUB} AS subsystem_id, unnest(functions) AS name FROM scan_records WHERE path IS NOT NULL) x JOIN (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(O.PHASES))}) AS v(i, p) ON contains(lower(x.name), p) GROUP BY ALL)
  SELECT csc_id, capsule_id, 'This capsule captures the current algorithm behavior around `' || scope || '`.' AS purpose, CASE WHEN ph IS NULL THEN 'Current flow evidence remains limited in this checkpoint capsule.' ELSE 'Current flow stages are reflected by the capsule phases: ' || array_to_string(list_transform(ph, lambda x: '`' || x.p || '`'), ', ') || '.' END AS flow, variants FROM cap LEFT JOIN phase USING (csc_id, subsystem_id)""")
def ref_v14_capsule_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """What can be said of each capsule without a model: its purpose and the phases of its subsystem in order."""
    return O.capsule_texts(O.capsules(O.algorithm_candidates(*_tables(spark, d, "edges", "nodes"))), load(spark, d, "scan_records"))


@query(_INSIGHTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY t_at, commit_id) AS i, row_number() OVER (PARTITION BY csc_id ORDER BY strength DESC, t_at, commit_id) AS r FROM delta),
  line AS (SELECT csc_id, greatest(6, min(strength) FILTER (WHERE r <= 3)) AS line, max(strength) AS top FROM r GROUP BY ALL), strong AS (SELECT r.* FROM r JOIN line USING (csc_id) WHERE strength >= line OR (top < line AND r = 1)),
  isl AS (SELECT *, i - row_number() OVER (PARTITION BY csc_id ORDER BY i) AS island FROM strong), win AS (SELECT csc_id, island, min(i) AS first, count(*) AS commits, max(strength) AS top, list_sort(list_distinct(flatten(list(signals)))) AS signals FROM isl GROUP BY ALL)
  SELECT csc_id, 'change-window::' || lpad(row_number() OVER (PARTITION BY csc_id ORDER BY first)::VARCHAR, 2, '0') AS window_id, commits, 'This interval window concentrates ' || coalesce(nullif(array_to_string(signals, ', '), ''), 'logic') || ' signals across ' || commits || ' commit(s).' AS summary, CASE WHEN top >= 10 THEN 'high' WHEN top >= 6 THEN 'medium' ELSE 'low' END AS significance FROM win""")
def ref_v15_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of strong commits in words, as told without a model."""
    return O.window_texts(*_tables(spark, d, "edges", "deps"))


@query(f"WITH m AS (SELECT DISTINCT csc_id, path, {_SUB} AS subsystem_id FROM scan_records WHERE path IS NOT NULL), s AS (SELECT csc_id, {_SUB} AS subsystem_id, count(DISTINCT coalesce(qualified_name, symbol_name)) AS symbols FROM graph_nodes WHERE node_type = 'symbol' AND path IS NOT NULL GROUP BY ALL) , x AS (SELECT m.csc_id, subsystem_id, regexp_replace(subsystem_id, '^subsystem::', '') AS display_name, count(*) AS files, coalesce(max(symbols), 0) AS symbols FROM m LEFT JOIN s USING (csc_id, subsystem_id) GROUP BY m.csc_id, subsystem_id) SELECT csc_id, subsystem_id, display_name, 'This subsystem groups active modules under `' || display_name || '` and currently spans ' || files || ' files and ' || symbols || ' symbols.' AS summary FROM x")
def ref_v16_subsystem_texts(spark: SparkSession, d: str) -> DataFrame:
    """Names and summaries of subsystems as told without a model."""
    return O.subsystem_texts(*_tables(spark, d, "scan", "nodes"))


_PACK = """ SELECT csc_id, 'subsystem' AS family, subsystem_id AS id FROM m UNION SELECT csc_id, 'module', 'module::' || path FROM m UNION SELECT csc_id, 'dependency', normalized_key FROM dependency_records WHERE normalized_key IS NOT NULL
  UNION SELECT csc_id, 'capsule', capsule_id FROM cap UNION SELECT csc_id, 'insight', insight_id FROM (WITH """ + _INSIGHTS.removeprefix("WITH ") + " SELECT * FROM insight) i"


@query(_CAPSULES + f", m AS (SELECT DISTINCT csc_id, path, {_SUB} AS subsystem_id FROM scan_records WHERE path IS NOT NULL), pack AS ({_PACK}) SELECT csc_id, family, count(*) AS ids, min(id) AS first_id, max(id) AS last_id FROM pack GROUP BY ALL")
def ref_v21_evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    """The ids of five kinds of evidence that drafts may refer to, in numbers and bounds."""
    return O.evidence_ids(*_tables(spark, d, "scan", "nodes", "edges", "deps")).groupBy("csc_id", "family").agg(F.count("*").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(_CAPSULES + f""", m AS (SELECT DISTINCT csc_id, path, {_SUB} AS subsystem_id FROM scan_records WHERE path IS NOT NULL), d_ AS (SELECT csc_id, normalized_key, language, count(DISTINCT source_path) AS modules FROM dependency_records WHERE normalized_key IS NOT NULL GROUP BY ALL)
  SELECT csc_id, 'concept' AS family, subsystem_id AS id, count(*) || ' modules' AS summary FROM m GROUP BY ALL UNION ALL SELECT csc_id, 'capsule', capsule_id, status || ': ' || array_to_string(signals, ', ') FROM cap
  UNION ALL SELECT csc_id, 'dependency', coalesce(language, 'unknown') || '::' || normalized_key, modules || ' modules' FROM d_""")
def ref_v27_draft_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What a draft is told of each concept, capsule and dependency."""
    return O.draft_summaries(*_tables(spark, d, "scan", "nodes", "edges", "deps"))
