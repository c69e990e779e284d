"""Queries over sources, roles, chunks of graph hits and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.globs import matches
from repolith.operators import corpus, manifests, repository, retrieval
from repolith.plans.repository import _LINES
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH c AS (SELECT DISTINCT workspace_id, checkpoint_id, target_commit_short AS told FROM history_checkpoints), n AS (SELECT workspace_id, max(checkpoint_id) AS checkpoint_id, 'new' AS told FROM c GROUP BY ALL) SELECT * FROM n UNION ALL SELECT * FROM c ANTI JOIN n USING (workspace_id, checkpoint_id)")
def ref_s19_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The plan of checkpoints with the last of each workspace replaced."""
    c = load(spark, d, "history_checkpoints").select("workspace_id", "checkpoint_id", F.col("target_commit_short").alias("told")).distinct()
    new = c.groupBy("workspace_id").agg(F.max("checkpoint_id").alias("checkpoint_id")).withColumn("told", F.lit("new"))
    return retrieval.upsert(c, new, ["workspace_id", "checkpoint_id"])


_ROOTS = ("src", "lib", "app", "absent")


@query("WITH r AS (SELECT unnest(['src', 'lib', 'app', 'absent']) AS root), c AS (SELECT DISTINCT csc_id FROM scan_records), f AS (SELECT DISTINCT csc_id, split_part(path, '/', 1) AS root FROM scan_records WHERE contains(path, '/')) SELECT c.csc_id, r.root, CASE WHEN f.root IS NULL THEN 'missing' ELSE 'analysed' END AS status FROM c CROSS JOIN r LEFT JOIN f ON f.csc_id = c.csc_id AND f.root = r.root")
def ref_s22_source_roots(spark: SparkSession, d: str) -> DataFrame:
    """Configured roots of each repository, analysed or missing; roots are a constant list."""
    return repository.source_roots(load(spark, d, "scan_records"), list(_ROOTS))


@query("WITH t AS (SELECT csc_id, source_path, max(file_fingerprint) AS told FROM corpus_units GROUP BY ALL), n AS (SELECT csc_id, path AS source_path, max(sha256(text)) AS now FROM scan_records GROUP BY ALL) SELECT csc_id, source_path, coalesce(told = now, false) AS reuse FROM t LEFT JOIN n USING (csc_id, source_path)")
def ref_s26_reusable(spark: SparkSession, d: str) -> DataFrame:
    """Files whose units can be reused, by fingerprint."""
    return corpus.reusable(load(spark, d, "corpus_units"), load(spark, d, "scan_records"))


@query(f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS k, csc_id, path, ls FROM (SELECT csc_id, path, {_LINES.format('text')} AS ls FROM (SELECT DISTINCT csc_id, path, text FROM scan_records)) WHERE len(ls) > 0),
  l AS (SELECT k, unnest(list_transform(ls, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9_]+'))))::BIGINT AS x, generate_subscripts(ls, 1) AS i FROM t),
  w AS (SELECT k, i, 1::BIGINT AS first, x AS total FROM l WHERE i = 1 UNION ALL SELECT l.k, l.i, CASE WHEN w.total + l.x > 400 THEN l.i ELSE w.first END, CASE WHEN w.total + l.x > 400 THEN l.x ELSE w.total + l.x END FROM w JOIN l ON l.k = w.k AND l.i = w.i + 1)
  SELECT csc_id, path, line_start, line_end, token_count FROM (SELECT k, first AS line_start, max(i) AS line_end, arg_max(total, i) AS token_count FROM w GROUP BY k, first) JOIN t USING (k)""")
def ref_w06_line_units(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at lines into units of at most 400 tokens, a longer line being a unit."""
    return corpus.line_units(load(spark, d, "scan_records"), 400)


_GROUPS = ("test", "dev", "docs", "lint-tools", "e2e_tests", "gpu", "", "typing", "qa", "format")


@query("SELECT g AS group_name, CASE WHEN n = '' THEN 'runtime' WHEN n IN ('test', 'tests', 'qa') THEN 'test' WHEN n IN ('dev', 'docs', 'lint', 'format', 'type', 'typing') THEN 'development' WHEN contains(n, 'test') THEN 'test' WHEN contains(n, 'dev') OR contains(n, 'lint') OR contains(n, 'docs') OR contains(n, 'type') THEN 'development' ELSE 'optional' END AS role FROM (SELECT g, replace(lower(g), '_', '-') AS n FROM (VALUES " + ", ".join(f"('{g}')" for g in _GROUPS) + ") AS v(g))")
def ref_p26_group_roles(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(g, manifests.group_role(g)) for g in _GROUPS], "group_name string, role string")


@query("""WITH e AS (SELECT DISTINCT csc_id, normalized_key, language FROM dependency_records WHERE normalized_key IS NOT NULL AND language = 'go'), m AS (SELECT DISTINCT csc_id, source_path, normalized_key AS used FROM dependency_records WHERE normalized_key IS NOT NULL AND language = 'go')
  SELECT e.csc_id, e.normalized_key, count(DISTINCT m.source_path) AS modules FROM e JOIN m ON m.csc_id = e.csc_id AND (m.used = e.normalized_key OR starts_with(m.used, e.normalized_key || '/')) GROUP BY ALL""")
def ref_f07_go_usage(spark: SparkSession, d: str) -> DataFrame:
    """Modules that import a Go package or one below it: every import is joined by each prefix of its path."""
    r = load(spark, d, "dependency_records").filter("normalized_key IS NOT NULL AND language = 'go'")
    parts = F.split("normalized_key", "/")
    used = r.select("csc_id", "source_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("normalized_key")).distinct()
    return r.select("csc_id", "normalized_key").distinct().join(used, ["csc_id", "normalized_key"]).groupBy("csc_id", "normalized_key").agg(F.count_distinct("source_path").alias("modules"))


@query("""WITH e AS (SELECT DISTINCT csc_id, source_id, target_id FROM graph_edges WHERE edge_type = 'documents' AND target_id LIKE 'file::%'), c AS (SELECT DISTINCT csc_id, chunk_id, source_path FROM knowledge_chunks WHERE source_type = 'code')
  SELECT e.csc_id, e.source_id AS section, c.chunk_id, 'file' AS via FROM e JOIN c ON c.csc_id = e.csc_id AND 'file::' || c.source_path = e.target_id GROUP BY ALL""")
def ref_j21_hit_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the files that a section's graph hits name."""
    e = load(spark, d, "graph_edges").filter("edge_type = 'documents' AND target_id LIKE 'file::%'").select("csc_id", F.col("source_id").alias("section"), F.substring("target_id", 7, 1 << 20).alias("source_path")).distinct()
    c = load(spark, d, "knowledge_chunks").filter("source_type = 'code'").select("csc_id", "chunk_id", "source_path").distinct()
    return e.join(c, ["csc_id", "source_path"]).select("csc_id", "section", "chunk_id", F.lit("file").alias("via")).distinct()


@query("SELECT csc_id, lower(symbol_name) AS name, count(DISTINCT node_id) AS symbols, count(DISTINCT path) AS files FROM graph_nodes WHERE node_type = 'symbol' AND symbol_name IS NOT NULL GROUP BY ALL")
def ref_j23_symbol_names(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "graph_nodes").filter("node_type = 'symbol' AND symbol_name IS NOT NULL")
    return s.groupBy("csc_id", F.lower("symbol_name").alias("name")).agg(F.count_distinct("node_id").alias("symbols"), F.count_distinct("path").alias("files"))


@query("""WITH i AS (SELECT DISTINCT csc_id, source_id AS commit_id, target_id AS section FROM graph_edges WHERE edge_type = 'impacts_section' AND target_id IS NOT NULL), f AS (SELECT csc_id, target_id AS commit_id, count(DISTINCT source_id) AS files FROM graph_edges WHERE edge_type = 'changed_in' AND target_id IS NOT NULL GROUP BY ALL)
  SELECT i.csc_id, i.section, count(*) AS commits, coalesce(sum(f.files), 0)::BIGINT AS files FROM i LEFT JOIN f USING (csc_id, commit_id) GROUP BY ALL""")
def ref_j18_section_windows(spark: SparkSession, d: str) -> DataFrame:
    """Commits that concern each section, with the files that they changed."""
    e = load(spark, d, "graph_edges").filter("target_id IS NOT NULL")
    i = e.filter("edge_type = 'impacts_section'").select("csc_id", F.col("source_id").alias("commit_id"), F.col("target_id").alias("section")).distinct()
    f = e.filter("edge_type = 'changed_in'").groupBy("csc_id", F.col("target_id").alias("commit_id")).agg(F.count_distinct("source_id").alias("files"))
    return i.join(f, ["csc_id", "commit_id"], "left").groupBy("csc_id", "section").agg(F.count("*").alias("commits"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


_AT = "try_cast(target_commit_timestamp AS timestamptz)"


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY t_at DESC NULLS LAST, checkpoint_id DESC) AS back FROM (SELECT DISTINCT workspace_id, checkpoint_id, previous_checkpoint_source AS src, {_AT} AS t_at FROM history_checkpoints))
  SELECT workspace_id, coalesce(arg_min(checkpoint_id, back) FILTER (WHERE back > 1 AND src IS NOT DISTINCT FROM 'explicit_override'), arg_max(checkpoint_id, back) FILTER (WHERE back > 1 AND back <= 4)) AS previous FROM c GROUP BY ALL""")
def ref_w10_previous_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint to compare the newest with: the newest explicit one before it, else the third before."""
    c = load(spark, d, "history_checkpoints").select("workspace_id", "checkpoint_id", F.col("previous_checkpoint_source").alias("src"), F.expr("try_cast(target_commit_timestamp AS timestamp_ltz)").alias("at")).distinct()
    b = c.withColumn("back", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("at").desc_nulls_last(), F.desc("checkpoint_id"))))
    told = F.min_by("checkpoint_id", F.when((F.col("back") > 1) & F.col("src").eqNullSafe("explicit_override"), F.col("back")))
    return b.groupBy("workspace_id").agg(F.coalesce(told, F.max_by("checkpoint_id", F.when((F.col("back") > 1) & (F.col("back") <= 4), F.col("back")))).alias("previous"))


_BIAS = "CASE i.intent || '/' || s.source_type " + " ".join(f"WHEN '{i}/{s}' THEN {v}" for (i, s), v in retrieval.TYPE_BIAS.items()) + " ELSE 0.01 END"


@query(f"SELECT i.intent, s.source_type, ({_BIAS})::DOUBLE AS bias FROM (VALUES " + ", ".join(f"('{i}')" for i in retrieval.INTENT_EDGES) + ") AS i(intent) CROSS JOIN (SELECT DISTINCT source_type FROM knowledge_chunks) s")
def ref_r02_type_bias(spark: SparkSession, d: str) -> DataFrame:
    """What each source type adds under each intent."""
    s = load(spark, d, "knowledge_chunks").select("source_type").distinct().select("source_type", F.explode(F.array(*map(F.lit, retrieval.INTENT_EDGES))).alias("intent"))
    return s.select("intent", "source_type", retrieval.type_bias(F.col("intent"), F.col("source_type")).alias("bias"))


@query("SELECT csc_id, chunk_id, 0.0::DOUBLE AS score FROM knowledge_chunks WHERE false")
def ref_r04_vector_source(spark: SparkSession, d: str) -> DataFrame:
    """The vector source, which has no candidates."""
    return load(spark, d, "knowledge_chunks").select("csc_id", "chunk_id", F.lit(0.0).alias("score")).filter(F.lit(False))


