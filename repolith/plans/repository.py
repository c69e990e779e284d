"""Queries over files, symbols, directories and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.languages import SUFFIXES, language_of
from repolith.functions.paths import normal_path
from repolith.functions.text import lines, stripped
from repolith.operators import repository as P
from repolith.operators.snapshots import snapshot_changes, validity_intervals
from repolith.plans.data_quality import _STANDING
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SUFFIX = "lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]+)$', 1))"
_LANGUAGE = f"CASE {_SUFFIX} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIXES.items()) + " ELSE 'unknown' END"
_FILES = f"file AS (SELECT DISTINCT csc_id, path, {_LANGUAGE} AS language FROM scan_records WHERE path IS NOT NULL)"
_UP = "list_concat(['.'], list_transform(range(1, len(string_split({0}, '/'))), lambda i: array_to_string(string_split({0}, '/')[1:i], '/')))"
_SPLIT = "string_split(regexp_replace(coalesce({0}, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{0085}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10))"
_LINES = f"CASE WHEN list_last({_SPLIT}) = '' THEN {_SPLIT}[:-2] ELSE {_SPLIT} END"


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "scan_records")


@query("SELECT DISTINCT csc_id, path FROM scan_records WHERE NOT regexp_matches(path, '(^|/)[^/]*_test\\.[^/]*$') AND (regexp_matches(path, '\\.(py|java|go|rs|ts|tsx|js|mjs|cjs|c|cc|cpp|h|hpp|cs)$') OR NOT regexp_matches(lower(path), '\\.(py|java|go|rs|ts|tsx|js|mjs|cjs|c|cc|cpp|h|hpp|cs)$'))")
def ref_s01_discover(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not excluded by `*_test.*`; included by suffix, or of no known language."""
    from repolith.functions.globs import matches

    include = [f"*{s}" for s in SUFFIXES]
    f = P.files(_scan(spark, d))
    return f.filter(~matches(F.col("path"), ["*_test.*"]) & (matches(F.col("path"), include) | (F.col("language") == "unknown"))).select("csc_id", "path")


@query(f"WITH {_FILES} SELECT csc_id, path, n FROM (SELECT csc_id, path, row_number() OVER (PARTITION BY csc_id ORDER BY path) AS n FROM file) WHERE n <= 20")
def ref_s02_first_files(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 files of each repository in order of path."""
    return P.files(_scan(spark, d)).select("csc_id", "path", F.row_number().over(Window.partitionBy("csc_id").orderBy("path")).alias("n")).filter("n <= 20")


@query("SELECT DISTINCT csc_id, unnest(imports) AS import FROM scan_records")
def ref_s03_imports(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select("csc_id", F.explode("imports").alias("import")).distinct()


@query(f"WITH {_FILES} SELECT * FROM file")
def ref_p03_language(spark: SparkSession, d: str) -> DataFrame:
    return P.files(_scan(spark, d))


@query(f"""WITH l AS (SELECT DISTINCT csc_id, path, {_LINES.format('text')} AS ls FROM scan_records WHERE text IS NOT NULL),
  c AS (SELECT csc_id, path, len(ls) AS n, unnest(range(0, len(ls), 40)) AS a, ls FROM l WHERE len(ls) > 0),
  t AS (SELECT csc_id, path, a + 1 AS line_start, least(a + 40, n) AS line_end, regexp_replace(array_to_string(ls[a + 1:a + 40], chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM c)
  SELECT csc_id, path, 'code::' || path || '::' || line_start || '-' || line_end AS chunk_id, line_start, line_end, text FROM t WHERE text <> ''""")
def ref_p04_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return P.line_chunks(_scan(spark, d))


@query("SELECT csc_id, dependency_id, array_to_string(list_filter(string_split(replace(target_path, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM (SELECT DISTINCT * FROM dependency_records) WHERE target_path IS NOT NULL")
def ref_p05_normal_paths(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "dependency_records").filter("target_path IS NOT NULL").distinct()
    return r.select("csc_id", "dependency_id", normal_path(F.col("target_path")).alias("path"))


_SUB = "'subsystem::' || CASE WHEN len(string_split(path, '/')) > 1 THEN split_part(path, '/', 1) ELSE '.' END || '::' || CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 2) ELSE '.' END"


@query(f"WITH {_FILES} SELECT csc_id, path, {_SUB} AS subsystem_id FROM file")
def ref_p20_subsystem(spark: SparkSession, d: str) -> DataFrame:
    return P.files(_scan(spark, d)).select("csc_id", "path", P.subsystem(F.col("path")).alias("subsystem_id"))


@query("SELECT DISTINCT csc_id, path, sha256(coalesce(text, '')) AS fingerprint FROM scan_records")
def ref_p22_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select("csc_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint")).distinct()


@query("SELECT DISTINCT csc_id, path, list_transform(list_concat([path], coalesce(functions, []), coalesce(classes, []), coalesce(imports, []), coalesce(docstrings, [])), lambda x: lower(x)) AS terms FROM scan_records")
def ref_p23_search_terms(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    every = F.concat(F.array("path"), *(F.coalesce(c, empty) for c in ("functions", "classes", "imports", "docstrings")))
    return _scan(spark, d).select("csc_id", "path", F.transform(every, F.lower).alias("terms")).distinct()


@query(f"WITH {_FILES} SELECT csc_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS area, count(*) AS files FROM file GROUP BY ALL")
def ref_p25_areas(spark: SparkSession, d: str) -> DataFrame:
    return P.files(_scan(spark, d)).groupBy("csc_id", F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".").alias("area")).agg(F.count("*").alias("files"))


@query(f"""SELECT DISTINCT csc_id, path, import FROM (SELECT csc_id, path, unnest(list_transform({_LINES.format('text')}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS import FROM scan_records WHERE {_LANGUAGE} = 'unknown')
  WHERE regexp_matches(import, '^(import|from\\s+\\S+\\s+import|#\\s*include|include|package|using|use)\\b')""")
def ref_x03_unknown_imports(spark: SparkSession, d: str) -> DataFrame:
    """Import-like lines of files of no known language."""
    f = _scan(spark, d).filter(language_of(F.col("path")) == "unknown").select("csc_id", "path", F.explode(lines(F.col("text"))).alias("l"))
    return f.select("csc_id", "path", stripped(F.col("l")).alias("import")).filter(F.col("import").rlike(r"^(import|from\s+\S+\s+import|#\s*include|include|package|using|use)\b")).distinct()


@query("""WITH s AS (SELECT csc_id, path, unnest(functions) AS name, 'function' AS kind FROM scan_records UNION SELECT csc_id, path, unnest(classes), 'class' FROM scan_records
  UNION SELECT csc_id, path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', ''), 'module' FROM scan_records WHERE len(coalesce(functions, [])) + len(coalesce(classes, [])) > 0)
  SELECT csc_id, 'sym::' || path || '::' || kind || '::' || name AS node_id, path, kind, name FROM s WHERE name IS NOT NULL AND path IS NOT NULL""")
def ref_x04_symbols(spark: SparkSession, d: str) -> DataFrame:
    return P.symbols(_scan(spark, d))


@query("SELECT DISTINCT csc_id, path, regexp_matches(path, '(^|/)[^/]*\\.py$') AS py, regexp_matches(path, '(^|/)[^/]+/[^/]+\\.go$') AS go_in_dir, regexp_matches(path, '(^|/)[^/]+/generator/[^/]+$') AS in_generator FROM scan_records WHERE path IS NOT NULL")
def ref_f01_globs(spark: SparkSession, d: str) -> DataFrame:
    """Right-anchored patterns in which `**` is exactly one segment."""
    from repolith.functions.globs import matches

    path = F.col("path")
    return _scan(spark, d).filter("path IS NOT NULL").select("csc_id", "path", matches(path, ["*.py"]).alias("py"), matches(path, ["**/*.go"]).alias("go_in_dir"), matches(path, ["**/generator/*"]).alias("in_generator")).distinct()


@query(f"""WITH own AS (SELECT csc_id, path, max(len(coalesce(functions, [])) + len(coalesce(classes, []))) AS symbols FROM scan_records WHERE path IS NOT NULL GROUP BY ALL),
  g AS (SELECT *, {_SUB} AS subsystem_id, {_LANGUAGE} AS language FROM own), r AS (SELECT *, row_number() OVER (PARTITION BY csc_id, subsystem_id ORDER BY path) AS r FROM g),
  l AS (SELECT csc_id, subsystem_id, list(language || '=' || n ORDER BY language) AS languages FROM (SELECT csc_id, subsystem_id, language, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL)
  SELECT r.csc_id, r.subsystem_id, count(*) AS file_count, sum(symbols)::BIGINT AS symbol_count, any_value(l.languages) AS languages, list(path ORDER BY path) FILTER (WHERE r <= 12) AS first_files
  FROM r JOIN l ON l.csc_id = r.csc_id AND l.subsystem_id = r.subsystem_id GROUP BY r.csc_id, r.subsystem_id""")
def ref_a04_subsystems(spark: SparkSession, d: str) -> DataFrame:
    return P.subsystems(_scan(spark, d))


@query(f"WITH {_FILES} SELECT csc_id, directory, language, count(*) AS files, CASE directory WHEN '.' THEN 0 ELSE len(string_split(directory, '/')) END AS depth FROM (SELECT csc_id, language, unnest({_UP.format('path')}) AS directory FROM file) GROUP BY ALL")
def ref_a05_rollup(spark: SparkSession, d: str) -> DataFrame:
    return P.rollup(_scan(spark, d))


@query(f"WITH {_FILES} SELECT csc_id, language, count(*) AS files FROM file GROUP BY ALL")
def ref_a28_languages(spark: SparkSession, d: str) -> DataFrame:
    return P.files(_scan(spark, d)).groupBy("csc_id", "language").agg(F.count("*").alias("files"))


@query("SELECT csc_id, node_type, count(*) AS nodes, count(DISTINCT node_id) AS ids FROM (SELECT DISTINCT * FROM graph_nodes) GROUP BY ALL")
def ref_a15_node_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "graph_nodes").distinct().groupBy("csc_id", "node_type").agg(F.count("*").alias("nodes"), F.count_distinct("node_id").alias("ids"))


@query("SELECT csc_id, edge_type, count(*) AS edges FROM (SELECT DISTINCT * FROM graph_edges) GROUP BY ALL")
def ref_a15_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "graph_edges").distinct().groupBy("csc_id", "edge_type").agg(F.count("*").alias("edges"))


_EDGE = "edge AS (SELECT DISTINCT csc_id, edge_id, edge_type, source_id, target_id FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"


@query(f"WITH {_EDGE} SELECT csc_id, node_id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, min(edge_id) AS first_edge FROM (SELECT csc_id, source_id AS node_id, 1 AS o, 0 AS i, edge_id FROM edge UNION ALL SELECT csc_id, target_id, 0, 1, edge_id FROM edge) GROUP BY ALL")
def ref_a16_degrees(spark: SparkSession, d: str) -> DataFrame:
    return P.degrees(load(spark, d, "graph_edges"))


_NODES = f"""{_FILES}, dirs AS (SELECT DISTINCT csc_id, unnest({_UP.format('path')}) AS path FROM file),
  node AS (SELECT csc_id, 'dir::' || path AS node_id, 'directory' AS node_type, path FROM dirs UNION ALL SELECT csc_id, 'file::' || path, 'file', path FROM file),
  link AS (SELECT csc_id, CASE node_type WHEN 'file' THEN 'contains' ELSE 'parent_of' END AS edge_type, 'dir::' || CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS source_id, node_id AS target_id FROM node WHERE path <> '.')"""


@query(f"WITH {_NODES} SELECT * FROM node")
def ref_g01_structure_nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.structure(_scan(spark, d))[0]


@query(f"WITH {_NODES} SELECT csc_id, 'edge::' || edge_type || '::' || source_id || '::' || target_id AS edge_id, edge_type, source_id, target_id FROM link")
def ref_g01_structure_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.structure(_scan(spark, d))[1]


@query("SELECT csc_id, node_id, symbol_kind, symbol_name, path, line_start FROM (SELECT *, row_number() OVER (PARTITION BY csc_id, node_id ORDER BY recorded_at, line_start NULLS FIRST, line_end NULLS FIRST) AS n FROM (SELECT DISTINCT * FROM graph_nodes WHERE node_type = 'symbol')) WHERE n = 1")
def ref_g04_symbol_inventory(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "graph_nodes").filter("node_type = 'symbol'").distinct()
    return P.first_rows(s, ["csc_id", "node_id"], [F.col("recorded_at"), F.col("line_start").asc_nulls_first(), F.col("line_end").asc_nulls_first()]).select("csc_id", "node_id", "symbol_kind", "symbol_name", "path", "line_start")


_NEAR = f"{_EDGE}, near AS (SELECT csc_id, source_id AS node_id, edge_id, edge_type, target_id AS neighbour FROM edge UNION ALL SELECT csc_id, target_id, edge_id, edge_type, source_id FROM edge WHERE source_id <> target_id)"


@query(f"WITH {_NEAR} SELECT * FROM near")
def ref_g05_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(load(spark, d, "graph_edges"))


@query(f"""WITH {_NEAR}, anchor AS (SELECT DISTINCT csc_id, node_id AS anchor FROM graph_nodes WHERE node_type = 'sdd_section'),
  one AS (SELECT csc_id, anchor, neighbour AS node_id, 1 AS distance, min(edge_id) AS edge_id, anchor AS via FROM anchor a JOIN near n USING (csc_id) WHERE n.node_id = a.anchor AND n.neighbour <> a.anchor GROUP BY ALL),
  two AS (SELECT o.csc_id, o.anchor, n.neighbour AS node_id, 2 AS distance, min({{'via': o.node_id, 'edge_id': n.edge_id}}) AS f FROM one o JOIN near n ON n.csc_id = o.csc_id AND n.node_id = o.node_id
          WHERE n.neighbour <> o.anchor AND NOT EXISTS (SELECT 1 FROM one x WHERE x.csc_id = o.csc_id AND x.anchor = o.anchor AND x.node_id = n.neighbour) GROUP BY ALL),
  hit AS (SELECT * FROM one UNION ALL SELECT csc_id, anchor, node_id, distance, f.edge_id AS edge_id, f.via AS via FROM two)
  SELECT csc_id, anchor, node_id, distance, edge_id, via FROM (SELECT *, row_number() OVER (PARTITION BY csc_id, anchor ORDER BY distance, via, edge_id, node_id) AS n FROM hit) WHERE n <= 48""")
def ref_g06_expand(spark: SparkSession, d: str) -> DataFrame:
    """Two steps around every document section."""
    anchors = load(spark, d, "graph_nodes").filter("node_type = 'sdd_section'").select("csc_id", F.col("node_id").alias("anchor")).distinct()
    return P.expand(anchors, load(spark, d, "graph_edges"))


@query(f"WITH {_NODES} SELECT n.csc_id, n.node_id, n.node_type, l.source_id AS parent_id, (SELECT count(*) FROM link c WHERE c.csc_id = n.csc_id AND c.source_id = n.node_id) AS children FROM node n LEFT JOIN link l ON l.csc_id = n.csc_id AND l.target_id = n.node_id")
def ref_g08_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = P.structure(_scan(spark, d))
    up = links.select("csc_id", F.col("target_id").alias("node_id"), F.col("source_id").alias("parent_id"))
    below = links.groupBy("csc_id", F.col("source_id").alias("node_id")).agg(F.count("*").alias("children"))
    return nodes.select("csc_id", "node_id", "node_type").join(up, ["csc_id", "node_id"], "left").join(below, ["csc_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))


@query("""SELECT csc_id, dependency_id, '{' || '"kind":"' || dependency_kind || '","raw":"' || replace(raw_dependency, '"', chr(92) || '"') || '","status":"' || lower(trim(resolution_status)) || '"' || coalesce(',"target":"' || replace(target_path, chr(92), chr(92) || chr(92)) || '"', '') || '}' AS reason
  FROM (SELECT DISTINCT * FROM dependency_records)""")
def ref_g09_import_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "dependency_records").distinct()
    return r.select("csc_id", "dependency_id", F.to_json(F.struct(F.col("dependency_kind").alias("kind"), F.col("raw_dependency").alias("raw"), F.lower(F.trim("resolution_status")).alias("status"), F.col("target_path").alias("target"))).alias("reason"))


@query(f"""WITH {_STANDING}, per AS (SELECT workspace_id, ord, count(*) AS fragments FROM standing GROUP BY ALL),
  moved AS (SELECT workspace_id, checkpoint_id, count(*) AS stale FROM change WHERE change_kind <> 'removed' GROUP BY ALL), gone AS (SELECT workspace_id, checkpoint_id, count(*) AS gone FROM change WHERE change_kind = 'removed' GROUP BY ALL)
  SELECT s.workspace_id, s.checkpoint_id, CASE WHEN s.ord = 1 THEN 'full' WHEN coalesce(stale, 0) + coalesce(gone, 0) = 0 THEN 'no_op' WHEN coalesce(stale, 0) = fragments THEN 'full' ELSE 'partial' END AS build,
    CASE WHEN s.ord = 1 THEN fragments ELSE coalesce(stale, 0) END AS rebuilt, coalesce(gone, 0) AS dropped
  FROM snap s JOIN per USING (workspace_id, ord) LEFT JOIN moved USING (workspace_id, checkpoint_id) LEFT JOIN gone USING (workspace_id, checkpoint_id)""")
def ref_g10_build_plan(spark: SparkSession, d: str) -> DataFrame:
    """Per snapshot: full at first or when all fragments are stale, nothing when none is, else partial."""
    from repolith.operators.snapshots import snapshot_order

    h, g = load(spark, d, "history_checkpoints"), load(spark, d, "graph_fingerprints")
    keys = ["workspace_id", "checkpoint_id"]
    moved = snapshot_changes(h, g).groupBy(*keys).agg(F.count_if(F.col("change_kind") != "removed").alias("stale"), F.count_if(F.col("change_kind") == "removed").alias("gone"))
    per = g.groupBy(*keys).agg(F.count_distinct(F.struct("fragment_id")).alias("fragments"))
    p = snapshot_order(h, g).select(*keys, "ord").join(per, keys).join(moved, keys, "left").fillna(0, ["stale", "gone"])
    first = F.col("ord") == 1
    return p.select(*keys, F.when(first, "full").when(F.col("stale") + F.col("gone") == 0, "no_op").when(F.col("stale") == F.col("fragments"), "full").otherwise("partial").alias("build"),
                    F.when(first, F.col("fragments")).otherwise(F.col("stale")).alias("rebuilt"), F.col("gone").alias("dropped"))


_TWO = f"""{_STANDING}, lastord AS (SELECT workspace_id, max(ord) AS m FROM snap GROUP BY ALL),
  new AS (SELECT s.workspace_id AS csc_id, substr(fragment_id, 7) AS path, digest FROM standing s JOIN lastord l USING (workspace_id) WHERE s.ord = l.m AND fragment_id LIKE 'file::%'),
  old AS (SELECT s.workspace_id AS csc_id, substr(fragment_id, 7) AS path, digest FROM standing s JOIN lastord l USING (workspace_id) WHERE s.ord = l.m - 1 AND fragment_id LIKE 'file::%')"""


@query(f"""WITH {_TWO}, moved AS (SELECT coalesce(o.csc_id, n.csc_id) AS csc_id, coalesce(o.path, n.path) AS path, n.path IS NOT NULL AS there FROM old o FULL JOIN new n ON o.csc_id = n.csc_id AND o.path = n.path
    WHERE o.path IS NULL OR n.path IS NULL OR o.digest IS DISTINCT FROM n.digest),
  kept AS (SELECT DISTINCT csc_id, unnest({_UP.format('path')}) AS path FROM new)
  SELECT csc_id, 'file' AS kind, path FROM moved WHERE there UNION ALL SELECT csc_id, 'directory', path FROM (SELECT DISTINCT csc_id, unnest({_UP.format('path')}) AS path FROM moved) SEMI JOIN kept USING (csc_id, path)""")
def ref_g12_rebuild_set(spark: SparkSession, d: str) -> DataFrame:
    """What has to be rebuilt at the last snapshot of each workspace."""
    spans = validity_intervals(load(spark, d, "history_checkpoints"), load(spark, d, "graph_fingerprints"))
    last = spans.groupBy("workspace_id").agg(F.max("end_ord").alias("m"))
    at = spans.join(last, "workspace_id").filter(F.col("fragment_id").startswith("file::")).select(F.col("workspace_id").alias("csc_id"), F.substring("fragment_id", 7, 9999).alias("path"), "digest", "start_ord", "end_ord", "m")
    return P.rebuild_set(at.filter("start_ord <= m - 1 AND end_ord >= m - 1").select("csc_id", "path", "digest"), at.filter("end_ord = m").select("csc_id", "path", "digest"))


@query("""WITH c AS (SELECT csc_id, node_id, label, count(*) OVER (PARTITION BY csc_id) AS n FROM (SELECT DISTINCT csc_id, node_id, label FROM graph_nodes WHERE node_type = 'commit')),
  e AS (SELECT DISTINCT csc_id, target_id, source_id FROM graph_edges WHERE edge_type = 'changed_in')
  SELECT c.csc_id, c.node_id, c.n = 1 AS only_commit, count(e.source_id) AS files FROM c LEFT JOIN e ON e.csc_id = c.csc_id AND e.target_id = c.node_id GROUP BY ALL""")
def ref_j20_commit_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Commits with the number of files changed in them; a repository's only commit is an anchor by itself."""
    c = load(spark, d, "graph_nodes").filter("node_type = 'commit'").select("csc_id", "node_id", "label").distinct()
    many = c.groupBy("csc_id").agg((F.count("*") == 1).alias("only_commit"))
    e = load(spark, d, "graph_edges").filter("edge_type = 'changed_in'").select("csc_id", F.col("target_id").alias("node_id"), "source_id").distinct().groupBy("csc_id", "node_id").agg(F.count("source_id").alias("files"))
    return c.join(many, "csc_id").join(e, ["csc_id", "node_id"], "left").select("csc_id", "node_id", "only_commit", F.coalesce("files", F.lit(0)).alias("files"))


@query("""WITH d AS (SELECT DISTINCT csc_id, source_id, target_id FROM graph_edges WHERE edge_type = 'documents'), c AS (SELECT DISTINCT csc_id, source_id, target_id FROM graph_edges WHERE edge_type = 'changed_in')
  SELECT d.csc_id, d.source_id AS section, c.target_id AS commit_id, count(*) AS files FROM d JOIN c ON c.csc_id = d.csc_id AND c.source_id = d.target_id WHERE c.target_id IS NOT NULL GROUP BY ALL""")
def ref_j11_impact(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose documented files a commit changed."""
    e = load(spark, d, "graph_edges").select("csc_id", "edge_type", "source_id", "target_id").distinct()
    documented = e.filter("edge_type = 'documents'").select("csc_id", F.col("source_id").alias("section"), F.col("target_id").alias("file"))
    changed = e.filter("edge_type = 'changed_in' AND target_id IS NOT NULL").select("csc_id", F.col("source_id").alias("file"), F.col("target_id").alias("commit_id"))
    return documented.join(changed, ["csc_id", "file"]).groupBy("csc_id", "section", "commit_id").agg(F.count("*").alias("files"))


@query("""WITH c AS (SELECT DISTINCT csc_id, chunk_id, source_path, line_start, line_end FROM knowledge_chunks WHERE source_type = 'code'), s AS (SELECT DISTINCT csc_id, node_id, path, line_start FROM graph_nodes WHERE node_type = 'symbol')
  SELECT c.csc_id, c.chunk_id, s.node_id FROM c JOIN s ON s.csc_id = c.csc_id AND s.path = c.source_path AND s.line_start BETWEEN c.line_start AND c.line_end GROUP BY ALL""")
def ref_j07_symbols_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose first line lies within a chunk of their file."""
    c = load(spark, d, "knowledge_chunks").filter("source_type = 'code'").select("csc_id", "chunk_id", F.col("source_path").alias("path"), F.col("line_start").alias("a"), F.col("line_end").alias("z"))
    s = load(spark, d, "graph_nodes").filter("node_type = 'symbol'").select("csc_id", "path", "node_id", "line_start")
    return c.join(s, ["csc_id", "path"]).filter("line_start BETWEEN a AND z").select("csc_id", "chunk_id", "node_id").distinct()


@query("SELECT csc_id, path, depth, row_number() OVER (PARTITION BY csc_id ORDER BY depth DESC, path) AS place FROM (SELECT DISTINCT csc_id, path, len(string_split(path, '/')) AS depth FROM graph_nodes WHERE node_type = 'directory')")
def ref_t08_deepest_first(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "graph_nodes").filter("node_type = 'directory'").select("csc_id", "path", F.size(F.split("path", "/")).alias("depth")).distinct()
    return n.withColumn("place", F.row_number().over(Window.partitionBy("csc_id").orderBy(F.desc("depth"), "path")))


@query(f"WITH {_NODES}, u AS (SELECT csc_id, node_id, node_type, 1 AS src FROM node UNION ALL SELECT csc_id, node_id, node_type, 2 FROM (SELECT DISTINCT csc_id, node_id, node_type FROM graph_nodes)) SELECT csc_id, node_id, arg_min(node_type, src) AS node_type, min(src) AS src FROM u GROUP BY csc_id, node_id")
def ref_u05_compose(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of two fragments, each once, from the first that has it."""
    nodes = P.structure(_scan(spark, d))[0].select("csc_id", "node_id", "node_type", F.lit(1).alias("src")).unionByName(
        load(spark, d, "graph_nodes").select("csc_id", "node_id", "node_type").distinct().withColumn("src", F.lit(2)))
    return nodes.groupBy("csc_id", "node_id").agg(F.min_by("node_type", "src").alias("node_type"), F.min("src").alias("src"))


@query(f"WITH {_TWO}, a AS (SELECT DISTINCT csc_id, regexp_extract(path, '^[^/]*/[^/]*') AS area FROM new), b AS (SELECT DISTINCT s.workspace_id AS csc_id, regexp_extract(substr(fragment_id, 7), '^[^/]*/[^/]*') AS area FROM standing s WHERE ord = 1 AND fragment_id LIKE 'file::%') SELECT * FROM a EXCEPT SELECT * FROM b")
def ref_u08_new_areas(spark: SparkSession, d: str) -> DataFrame:
    """Directories of the top two levels in the last snapshot that the first did not have."""
    spans = validity_intervals(load(spark, d, "history_checkpoints"), load(spark, d, "graph_fingerprints"))
    last = spans.groupBy("workspace_id").agg(F.max("end_ord").alias("m"))
    at = spans.join(last, "workspace_id").filter(F.col("fragment_id").startswith("file::")).select(F.col("workspace_id").alias("csc_id"), F.regexp_extract(F.substring("fragment_id", 7, 9999), "^[^/]*/[^/]*", 0).alias("area"), "start_ord", "end_ord", "m")
    return at.filter("end_ord = m").select("csc_id", "area").distinct().join(at.filter("start_ord = 1").select("csc_id", "area").distinct(), ["csc_id", "area"], "left_anti")


