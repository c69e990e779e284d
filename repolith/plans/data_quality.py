"""Queries p2_* (orphan references) and p6_* (snapshot changes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators import orphans, snapshots
from repolith.session import load


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_cascade(*(load(spark, d, t) for t in ("graph_nodes", "graph_edges", "dependency_records")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of edges and dependencies."""
    return _cascade(spark, d).filter("kind = 'direct' AND ref_table <> 'graph_nodes'").select("ref_table", "csc_id", "record_key", "ref_field").distinct()


def p2_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans of all three tables with their depth."""
    return _cascade(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, kind and month."""
    return orphans.orphan_report(_cascade(spark, d))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "history_checkpoints"), load(spark, d, "graph_fingerprints")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Fragments added, removed or changed since the preceding snapshot."""
    return snapshots.snapshot_changes(*_snapshots(spark, d))


def p6_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Validity intervals of every fragment."""
    return snapshots.validity_intervals(*_snapshots(spark, d)).select("workspace_id", "fragment_id", "digest", "start_ord", "end_ord")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of changes per later snapshot."""
    return snapshots.change_summary(*_snapshots(spark, d)).select(
        "workspace_id", "checkpoint_id", "tree_changed", *(F.col(k).cast("long").alias(k) for k in ("added", "removed", "changed")))


_PATH = "array_to_string(list_filter(string_split(replace({0}, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'), '/')"
_ID = "CASE WHEN {0} LIKE 'file::%' THEN 'file::' || " + _PATH.format("substr({0}, 7)") + " ELSE {0} END"
_REFS = f"""
node AS (SELECT DISTINCT csc_id, {_ID.format('node_id')} AS id, recorded_at AS a, removed_at AS b FROM graph_nodes),
ref AS (
  SELECT DISTINCT 'graph_edges' AS ref_table, csc_id, edge_id AS record_key, 'source_id' AS ref_field, {_ID.format('source_id')} AS id, recorded_at AS t_at FROM graph_edges WHERE source_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'graph_edges', csc_id, edge_id, 'target_id', {_ID.format('target_id')}, recorded_at FROM graph_edges WHERE target_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'dependency_records', csc_id, dependency_id, 'target_path', 'file::' || {_PATH.format('target_path')}, recorded_at
  FROM dependency_records WHERE lower(trim(resolution_status)) IN ('resolved_exact', 'resolved_heuristic')),
tested AS (
  SELECT r.ref_table, r.csc_id, r.record_key, r.ref_field, r.id, r.t_at,
         coalesce(bool_or(n.a <= r.t_at AND (n.b IS NULL OR r.t_at < n.b)), false) AS is_live
  FROM ref r LEFT JOIN node n ON n.csc_id = r.csc_id AND n.id = r.id GROUP BY ALL)"""
_CASCADE = f"""WITH RECURSIVE {_REFS},
family AS (
  SELECT DISTINCT csc_id, {_ID.format('node_id')} AS node, recorded_at AS t_at,
    CASE WHEN split_part(node_id, '::', 1) IN ('file', 'dir') THEN 'dir::' || regexp_replace({_PATH.format('path')}, '/[^/]*$', '')
         ELSE 'file::' || {_PATH.format('path')} END AS parent
  FROM graph_nodes WHERE path IS NOT NULL AND NOT (split_part(node_id, '::', 1) IN ('file', 'dir') AND NOT contains({_PATH.format('path')}, '/'))),
base AS (
  SELECT f.csc_id, f.node, f.t_at FROM family f LEFT JOIN node n ON n.csc_id = f.csc_id AND n.id = f.parent
  GROUP BY f.csc_id, f.node, f.t_at, f.parent HAVING NOT coalesce(bool_or(n.a <= f.t_at AND (n.b IS NULL OR f.t_at < n.b)), false)),
down AS (
  SELECT csc_id, node, t_at, 0 AS depth FROM base
  UNION
  SELECT f.csc_id, f.node, f.t_at, d.depth + 1 FROM down d JOIN family f ON f.csc_id = d.csc_id AND f.parent = d.node),
lost AS (SELECT csc_id, node, t_at, min(depth) AS depth FROM down GROUP BY ALL),
cascade AS (
  SELECT ref_table, csc_id, record_key, ref_field, t_at AS recorded_at, 'direct' AS kind, 0 AS depth FROM tested WHERE NOT is_live
  UNION ALL
  SELECT t.ref_table, t.csc_id, t.record_key, t.ref_field, t.t_at, 'inherited', l.depth + 1
  FROM tested t JOIN (SELECT csc_id, node, min(depth) AS depth FROM lost GROUP BY ALL) l ON l.csc_id = t.csc_id AND l.node = t.id WHERE t.is_live
  UNION ALL
  SELECT 'graph_nodes', csc_id, node, 'parent', t_at, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END, depth FROM lost)"""
_STANDING = """
known AS (SELECT workspace_id, checkpoint_id, max(try_cast(target_commit_timestamp AS timestamptz)) AS t_at, max(tree_sha) AS tree_sha FROM history_checkpoints GROUP BY ALL),
snap AS (
  SELECT workspace_id, checkpoint_id, tree_sha, row_number() OVER w AS ord, lag(tree_sha) OVER w AS prev_tree_sha
  FROM known SEMI JOIN graph_fingerprints USING (workspace_id, checkpoint_id)
  WINDOW w AS (PARTITION BY workspace_id ORDER BY t_at NULLS FIRST, checkpoint_id)),
ranked AS (
  SELECT workspace_id, checkpoint_id, fragment_id, lower(regexp_replace(digest, '^[^:]*:', '')) AS digest,
         row_number() OVER (PARTITION BY workspace_id, checkpoint_id, fragment_id ORDER BY delivered_at DESC NULLS LAST, lower(regexp_replace(digest, '^[^:]*:', '')) DESC NULLS LAST) AS rn
  FROM graph_fingerprints),
standing AS (SELECT r.workspace_id, r.checkpoint_id, r.fragment_id, r.digest, s.ord FROM ranked r JOIN snap s USING (workspace_id, checkpoint_id) WHERE rn = 1),
change AS (
  SELECT c.workspace_id, c.checkpoint_id, c.fragment_id, CASE WHEN p.ord IS NULL THEN 'added' ELSE 'changed' END AS change_kind
  FROM standing c LEFT JOIN standing p ON p.workspace_id = c.workspace_id AND p.fragment_id IS NOT DISTINCT FROM c.fragment_id AND p.ord = c.ord - 1
  WHERE c.ord > 1 AND (p.ord IS NULL OR p.digest IS DISTINCT FROM c.digest)
  UNION ALL
  SELECT p.workspace_id, s.checkpoint_id, p.fragment_id, 'removed'
  FROM standing p JOIN snap s ON s.workspace_id = p.workspace_id AND s.ord = p.ord + 1
  LEFT JOIN standing c ON c.workspace_id = p.workspace_id AND c.fragment_id IS NOT DISTINCT FROM p.fragment_id AND c.ord = p.ord + 1
  WHERE c.ord IS NULL)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_cascade, p2_report, p6_found, p6_intervals, p6_summary)}
SQL = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, csc_id, record_key, ref_field FROM tested WHERE NOT is_live",
    "p2_cascade": _CASCADE + " SELECT * FROM cascade",
    "p2_report": _CASCADE + " SELECT ref_table, ref_field, kind, strftime(recorded_at, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT csc_id) AS repositories FROM cascade GROUP BY ALL",
    "p6_found": f"WITH {_STANDING} SELECT * FROM change",
    "p6_intervals": f"""WITH {_STANDING},
      run AS (SELECT *, sum(CASE WHEN prev = ord - 1 AND before IS NOT DISTINCT FROM digest THEN 0 ELSE 1 END) OVER (PARTITION BY workspace_id, fragment_id ORDER BY ord) AS island
              FROM (SELECT *, lag(ord) OVER w AS prev, lag(digest) OVER w AS before FROM standing WINDOW w AS (PARTITION BY workspace_id, fragment_id ORDER BY ord)))
      SELECT workspace_id, fragment_id, any_value(digest) AS digest, min(ord) AS start_ord, max(ord) AS end_ord FROM run GROUP BY workspace_id, fragment_id, island""",
    "p6_summary": f"""WITH {_STANDING}
      SELECT s.workspace_id, s.checkpoint_id, any_value(s.tree_sha IS DISTINCT FROM s.prev_tree_sha) AS tree_changed, count(*) FILTER (WHERE change_kind = 'added') AS added,
             count(*) FILTER (WHERE change_kind = 'removed') AS removed, count(*) FILTER (WHERE change_kind = 'changed') AS changed
      FROM snap s LEFT JOIN change c USING (workspace_id, checkpoint_id) WHERE s.ord > 1 GROUP BY s.workspace_id, s.checkpoint_id""",
}
