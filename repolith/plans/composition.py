"""Queries over graph candidates, capsules, outlines, narratives, reviews and screenings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.text import tokens
from repolith.operators import history, rendering, repository
from repolith.operators.snapshots import validity_intervals
from repolith.plans import evidence
from repolith.plans.data_quality import _STANDING
from repolith.plans.history import _DELTAS
from repolith.plans.repository import SQL as REPOSITORY_SQL
from repolith.plans.repository import _SUB, ref_g06_expand
from repolith.plans.retrieval import _TOK
from repolith.session import load
from repolith.workspace import as_json

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT csc_id, anchor, node_id, round(1.0 / greatest(distance, 1), 6)::DOUBLE AS graph_score FROM ({REPOSITORY_SQL['ref_g06_expand']})")
def ref_r03_graph_score(spark: SparkSession, d: str) -> DataFrame:
    """Graph hits score one over their distance."""
    return ref_g06_expand(spark, d).select("csc_id", "anchor", "node_id", F.round(1 / F.greatest("distance", F.lit(1)), 6).alias("graph_score"))


@query(f"""WITH h AS (SELECT * FROM ({REPOSITORY_SQL['ref_g06_expand']})), c AS (SELECT DISTINCT csc_id, chunk_id, source_path FROM knowledge_chunks WHERE source_type = 'code')
  SELECT h.csc_id, h.anchor, c.chunk_id, max(1.0 / h.distance)::DOUBLE AS graph_score, count(DISTINCT h.node_id) AS hits FROM h JOIN c ON c.csc_id = h.csc_id AND (h.node_id = 'chunk::' || c.chunk_id OR h.node_id = 'file::' || c.source_path) GROUP BY ALL""")
def ref_g07_graph_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that graph hits name, by themselves or through their file, with the best score."""
    h = ref_g06_expand(spark, d).select("csc_id", "anchor", "node_id", "distance")
    c = load(spark, d, "knowledge_chunks").filter("source_type = 'code'").select("csc_id", "chunk_id", F.explode(F.array(F.concat(F.lit("chunk::"), "chunk_id"), F.concat(F.lit("file::"), "source_path"))).alias("node_id")).distinct()
    return h.join(c, ["csc_id", "node_id"]).groupBy("csc_id", "anchor", "chunk_id").agg(F.max(1 / F.col("distance")).alias("graph_score"), F.count_distinct("node_id").alias("hits"))


@query("""WITH n AS (SELECT csc_id, node_id, arg_min(node_type, node_type) AS node_type, count(*) AS spans FROM (SELECT DISTINCT csc_id, node_id, node_type, recorded_at FROM graph_nodes) GROUP BY ALL), e AS (SELECT DISTINCT csc_id, edge_id, source_id FROM graph_edges)
  SELECT n.csc_id, n.node_type, count(DISTINCT n.node_id) AS nodes, count(e.edge_id) AS outgoing FROM n LEFT JOIN e ON e.csc_id = n.csc_id AND e.source_id = n.node_id GROUP BY ALL""")
def ref_s16_graph_load(spark: SparkSession, d: str) -> DataFrame:
    """A graph read from nodes and edges alone; what hangs on a node is counted from the edges."""
    n = load(spark, d, "graph_nodes").groupBy("csc_id", "node_id").agg(F.min("node_type").alias("node_type"))
    e = load(spark, d, "graph_edges").select("csc_id", "edge_id", F.col("source_id").alias("node_id")).distinct().groupBy("csc_id", "node_id").agg(F.count("*").alias("o"))
    return n.join(e, ["csc_id", "node_id"], "left").groupBy("csc_id", "node_type").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("o"), F.lit(0)).alias("outgoing"))


@query("""SELECT '{"checkpoint_id":"' || checkpoint_id || '","tree_sha":"' || tree_sha || '","workspace_id":"' || workspace_id || '"}' AS value FROM (SELECT DISTINCT checkpoint_id, tree_sha, workspace_id FROM history_checkpoints WHERE tree_sha IS NOT NULL)""")
def ref_s20_json(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints as JSON rows for export."""
    return as_json(load(spark, d, "history_checkpoints").select("workspace_id", "checkpoint_id", "tree_sha").filter("tree_sha IS NOT NULL").distinct())


@query(f"WITH {_STANDING}, m AS (SELECT workspace_id, max(ord) AS m FROM snap GROUP BY ALL) SELECT DISTINCT s.workspace_id, s.fragment_id FROM standing s JOIN m USING (workspace_id) WHERE NOT EXISTS (SELECT 1 FROM standing t WHERE t.workspace_id = s.workspace_id AND t.fragment_id IS NOT DISTINCT FROM s.fragment_id AND t.ord = m.m)")
def ref_s24_stale_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of some snapshot that the last one of their workspace lacks, whose files can go."""
    spans = validity_intervals(load(spark, d, "history_checkpoints"), load(spark, d, "graph_fingerprints"))
    last = spans.groupBy("workspace_id").agg(F.max("end_ord").alias("m"))
    return spans.groupBy("workspace_id", "fragment_id").agg(F.max("end_ord").alias("e")).join(last, "workspace_id").filter("e < m").select("workspace_id", "fragment_id")


@query("""WITH f AS (SELECT DISTINCT csc_id, path FROM scan_records WHERE path IS NOT NULL), s AS (SELECT DISTINCT csc_id, source_path AS path FROM knowledge_chunks WHERE source_type = 'file_summary')
  SELECT f.csc_id, f.path, CASE WHEN s.path IS NULL THEN 'rebuilt' ELSE 'reused' END AS origin FROM f LEFT JOIN s ON s.csc_id = f.csc_id AND s.path = f.path""")
def ref_s25_hierarchy_rows(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of files: those that a store has are reused, the others rebuilt."""
    f = load(spark, d, "scan_records").select("csc_id", "path").filter("path IS NOT NULL").distinct()
    s = load(spark, d, "knowledge_chunks").filter("source_type = 'file_summary'").select("csc_id", F.col("source_path").alias("path")).distinct()
    return f.join(s, ["csc_id", "path"], "left_semi").withColumn("origin", F.lit("reused")).unionByName(f.join(s, ["csc_id", "path"], "left_anti").withColumn("origin", F.lit("rebuilt")))


@query("""WITH s AS (SELECT csc_id, path, symbol_name AS name, qualified_name, node_id, row_number() OVER (PARTITION BY csc_id, path, symbol_name ORDER BY coalesce(qualified_name, ''), symbol_kind, coalesce(line_start, -1), node_id) AS n FROM (SELECT DISTINCT csc_id, path, symbol_name, qualified_name, symbol_kind, line_start, node_id FROM graph_nodes WHERE node_type = 'symbol' AND symbol_name IS NOT NULL))
  SELECT csc_id, path, name, node_id FROM s WHERE n = 1""")
def ref_j15_first_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Of the symbols of a file that share a name the first in order."""
    s = load(spark, d, "graph_nodes").filter("node_type = 'symbol' AND symbol_name IS NOT NULL").select("csc_id", "path", F.col("symbol_name").alias("name"), "qualified_name", "symbol_kind", "line_start", "node_id").distinct()
    return repository.first_rows(s, ["csc_id", "path", "name"], [F.coalesce("qualified_name", F.lit("")), F.col("symbol_kind"), F.coalesce("line_start", F.lit(-1)), F.col("node_id")]).select("csc_id", "path", "name", "node_id")


_CORE = ("introduction", "architectural_overview", "subsystems_modules", "dependencies", "build_development_infrastructure")


@query(f"""WITH q AS (SELECT DISTINCT 'csc' || substr(workspace_id, 3) AS csc_id, checkpoint_id AS question_id, unnest({_TOK.format('target_commit_subject')}) AS term FROM history_checkpoints), k AS (SELECT DISTINCT csc_id, chunk_id, unnest({_TOK.format('text')}) AS term FROM knowledge_chunks WHERE source_type = 'code'),
  h AS (SELECT q.csc_id, q.question_id, k.chunk_id, count(*) AS terms FROM q JOIN k USING (csc_id, term) GROUP BY ALL), a AS (SELECT DISTINCT csc_id, question_id FROM q)
  SELECT a.csc_id, a.question_id, count(h.chunk_id) AS screened, CASE WHEN coalesce(max(h.terms), 0) < 2 THEN 'insufficient evidence' ELSE 'answerable' END AS verdict FROM a LEFT JOIN h USING (csc_id, question_id) GROUP BY ALL""")
def ref_d10_screening(spark: SparkSession, d: str) -> DataFrame:
    """Chunks screened for each question by its words; without a chunk that has two of them the answer stays conservative."""
    q = load(spark, d, "history_checkpoints").select(F.concat(F.lit("csc"), F.substring("workspace_id", 3, 99)).alias("csc_id"), F.col("checkpoint_id").alias("question_id"), F.explode(tokens(F.col("target_commit_subject"))).alias("term")).distinct()
    return _screened(q, load(spark, d, "knowledge_chunks"))


def _screened(q: DataFrame, chunks: DataFrame) -> DataFrame:
    k = chunks.filter("source_type = 'code'").select("csc_id", "chunk_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    h = q.join(k, ["csc_id", "term"]).groupBy("csc_id", "question_id", "chunk_id").agg(F.count("*").alias("terms"))
    return q.select("csc_id", "question_id").distinct().join(h, ["csc_id", "question_id"], "left").groupBy("csc_id", "question_id").agg(
        F.count("chunk_id").alias("screened"), F.when(F.coalesce(F.max("terms"), F.lit(0)) < 2, "insufficient evidence").otherwise("answerable").alias("verdict"))


@query(f"""WITH q AS (SELECT DISTINCT csc_id, doc_id::VARCHAR AS question_id, unnest({_TOK.format('text')}) AS term FROM documents WHERE doc_id % 20 = 0 AND csc_id IS NOT NULL), k AS (SELECT DISTINCT csc_id, chunk_id, unnest({_TOK.format('text')}) AS term FROM knowledge_chunks WHERE source_type = 'code'),
  h AS (SELECT q.csc_id, q.question_id, k.chunk_id, count(*) AS terms FROM q JOIN k USING (csc_id, term) GROUP BY ALL), a AS (SELECT DISTINCT csc_id, question_id FROM q)
  SELECT a.csc_id, a.question_id, count(h.chunk_id) AS screened, CASE WHEN coalesce(max(h.terms), 0) < 2 THEN 'insufficient evidence' ELSE 'answerable' END AS verdict FROM a LEFT JOIN h USING (csc_id, question_id) GROUP BY ALL""")
def ref_d10_screening_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same for the texts of every twentieth document, asked of its own repository."""
    q = load(spark, d, "documents").filter("doc_id % 20 = 0 AND csc_id IS NOT NULL").select("csc_id", F.col("doc_id").cast("string").alias("question_id"), F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return _screened(q, load(spark, d, "knowledge_chunks"))
