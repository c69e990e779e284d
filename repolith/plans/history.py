"""Queries over commits, checkpoints and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.operators import history as H
from repolith.operators.outline import PHASES
from repolith.operators.snapshots import snapshot_changes, snapshot_order
from repolith.plans.data_quality import _STANDING
from repolith.plans.repository import _SUB, _LANGUAGE
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NORMAL = "array_to_string(list_filter(string_split(replace(substr(source_id, 7), chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'), '/')"
_DELTAS = f"""WITH f AS (SELECT csc_id, target_id AS commit_id, {_NORMAL} AS path, min(recorded_at) AS t_at FROM graph_edges WHERE edge_type = 'changed_in' AND target_id LIKE 'commit::%' AND source_id LIKE 'file::%' GROUP BY ALL),
  dep AS (SELECT DISTINCT csc_id, source_path AS path FROM dependency_records),
  g AS (SELECT f.csc_id, commit_id, min(t_at) AS t_at, count(*) AS files, count(DISTINCT {_SUB.replace('path', 'f.path')}) AS subsystems, count(*) FILTER (WHERE {_LANGUAGE.replace('(path', '(f.path')} = 'unknown') AS build_files,
    count(*) FILTER (WHERE regexp_matches(regexp_extract(lower(f.path), '([^/]*?)(?:\\.[^./]*)?$', 1), 'strategy|variant|policy|mode|backend|adapter')) AS variants, bool_or(dep.path IS NOT NULL) AS dep, bool_or(regexp_matches(f.path, '\\.(h|hpp|ts)$')) AS face
    FROM f LEFT JOIN dep ON dep.csc_id = f.csc_id AND dep.path = f.path GROUP BY f.csc_id, commit_id),
  s AS (SELECT csc_id, commit_id, t_at, files, subsystems, build_files, variants, list_filter([CASE WHEN variants > 0 THEN 'algorithm' END, CASE WHEN subsystems > 1 THEN 'architectural' END, CASE WHEN dep THEN 'dependency' END, CASE WHEN build_files > 0 THEN 'infrastructure' END, CASE WHEN face THEN 'interface' END], lambda x: x IS NOT NULL) AS signals FROM g),
  delta AS (SELECT *, len(signals) * 3 + subsystems * 2 + build_files * 2 + least(files, 4) AS strength FROM s)"""


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return H.commit_deltas(load(spark, d, "graph_edges"), load(spark, d, "dependency_records"))


def _snap(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "history_checkpoints"), load(spark, d, "graph_fingerprints")


@query(_DELTAS + " SELECT csc_id, commit_id, t_at AS at, files, subsystems, build_files, variants, signals, strength FROM delta")
def ref_a09_commit_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d)


@query(_DELTAS + " SELECT csc_id, commit_id, strength, CASE WHEN strength >= 10 THEN 'high' WHEN strength >= 6 THEN 'medium' ELSE 'low' END AS significance FROM delta")
def ref_a23_significance(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).select("csc_id", "commit_id", "strength", H.significance(F.col("strength")).alias("significance"))


@query(_DELTAS + """, r AS (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY t_at, commit_id) AS i, row_number() OVER (PARTITION BY csc_id ORDER BY strength DESC, t_at, commit_id) AS r FROM delta),
  line AS (SELECT csc_id, greatest(6, min(strength) FILTER (WHERE r <= 3)) AS line, max(strength) AS top FROM r GROUP BY ALL),
  strong AS (SELECT r.* FROM r JOIN line USING (csc_id) WHERE strength >= line OR (top < line AND r = 1)),
  isl AS (SELECT *, i - row_number() OVER (PARTITION BY csc_id ORDER BY i) AS island FROM strong),
  run AS (SELECT csc_id, island, count(*) AS commits, min(i) AS first, arg_min(commit_id, i) AS first_commit, arg_max(commit_id, i) AS last_commit, sum(strength)::BIGINT AS strength FROM isl GROUP BY ALL)
  SELECT csc_id, row_number() OVER (PARTITION BY csc_id ORDER BY first) AS "window", commits, first_commit, last_commit, strength FROM run""")
def ref_w03_strong_windows(spark: SparkSession, d: str) -> DataFrame:
    return H.strong_windows(_deltas(spark, d))


@query(_DELTAS + " SELECT csc_id, commit_id, strength, n FROM (SELECT csc_id, commit_id, strength, row_number() OVER (PARTITION BY csc_id ORDER BY strength DESC, t_at, commit_id) AS n FROM delta) WHERE n <= 12")
def ref_t05_top_commits(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("csc_id").orderBy(F.desc("strength"), "at", "commit_id")
    return _deltas(spark, d).select("csc_id", "commit_id", "strength", F.row_number().over(w).alias("n")).filter("n <= 12")


@query(_DELTAS + " SELECT csc_id, commit_id, gap FROM (SELECT csc_id, commit_id, date_diff('second', lag(t_at) OVER (PARTITION BY csc_id ORDER BY t_at, commit_id), t_at) AS gap FROM delta WHERE len(signals) > 0) WHERE gap IS NOT NULL")
def ref_w04_candidate_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from the candidate before to each commit that has a signal."""
    w = Window.partitionBy("csc_id").orderBy("at", "commit_id")
    gap = F.date_trunc("second", "at").cast("long") - F.date_trunc("second", F.lag("at").over(w)).cast("long")
    return _deltas(spark, d).filter(F.size("signals") > 0).select("csc_id", "commit_id", gap.alias("gap")).filter("gap IS NOT NULL")


@query(_DELTAS + " SELECT csc_id, signal, count(*) AS commits, sum(files)::BIGINT AS files FROM (SELECT csc_id, files, unnest(signals) AS signal FROM delta) GROUP BY ALL")
def ref_a33_signal_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).select("csc_id", "files", F.explode("signals").alias("signal")).groupBy("csc_id", "signal").agg(F.count("*").alias("commits"), F.sum("files").alias("files"))


@query(_DELTAS + f" SELECT csc_id, {_SUB} AS subsystem_id, count(DISTINCT commit_id) AS commits, count(DISTINCT path) AS files, min(t_at) AS first_at, max(t_at) AS last_at FROM f GROUP BY ALL")
def ref_a07_subsystem_changes(spark: SparkSession, d: str) -> DataFrame:
    from repolith.operators.repository import subsystem

    return H.commit_files(load(spark, d, "graph_edges")).groupBy("csc_id", subsystem(F.col("path")).alias("subsystem_id")).agg(
        F.count_distinct("commit_id").alias("commits"), F.count_distinct("path").alias("files"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


_LIFE = f"""WITH {_STANDING}, n AS (SELECT *, lag(ord) OVER w AS po, lag(digest) OVER w AS pd, lead(ord) OVER w AS nxt FROM standing WINDOW w AS (PARTITION BY workspace_id, fragment_id ORDER BY ord)),
  life AS (SELECT workspace_id, fragment_id, checkpoint_id, ord, CASE WHEN ord = 1 THEN 'observed' WHEN po IS NULL OR po <> ord - 1 THEN 'introduced' WHEN pd IS NOT DISTINCT FROM digest THEN 'unchanged' ELSE 'modified' END AS status FROM n
    UNION ALL SELECT n.workspace_id, n.fragment_id, s.checkpoint_id, n.ord + 1, 'retired' FROM n JOIN snap s ON s.workspace_id = n.workspace_id AND s.ord = n.ord + 1 WHERE n.nxt IS NULL OR n.nxt <> n.ord + 1)"""


@query(_LIFE + " SELECT * FROM life")
def ref_j13_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return H.lifecycle(*_snap(spark, d))


@query(_LIFE + ", p AS (SELECT *, list_position(['introduced', 'retired', 'modified', 'observed', 'unchanged'], status) AS place FROM life) SELECT workspace_id, fragment_id, arg_min(checkpoint_id, ord) AS first_seen, arg_max(checkpoint_id, ord) FILTER (WHERE status <> 'unchanged') AS last_updated, arg_min(status, place) AS status FROM p GROUP BY ALL")
def ref_w07_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    return H.first_and_last(H.lifecycle(*_snap(spark, d)))


@query(_LIFE + " SELECT workspace_id, checkpoint_id, status, count(*) AS fragments FROM life GROUP BY ALL")
def ref_a08_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.lifecycle(*_snap(spark, d)).groupBy("workspace_id", "checkpoint_id", "status").agg(F.count("*").alias("fragments"))


@query(_LIFE + " SELECT workspace_id, fragment_id, status FROM life JOIN (SELECT workspace_id, max(ord) AS m FROM snap GROUP BY ALL) USING (workspace_id) WHERE ord = m AND status <> 'retired'")
def ref_f02_active(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that the last snapshot of their workspace holds."""
    life = H.lifecycle(*_snap(spark, d))
    last = snapshot_order(*_snap(spark, d)).groupBy("workspace_id").agg(F.max("ord").alias("m"))
    return life.join(last, "workspace_id").filter("ord = m AND status <> 'retired'").select("workspace_id", "fragment_id", "status")


_AT = "try_cast(target_commit_timestamp AS timestamptz)"


@query(f"WITH c AS (SELECT DISTINCT workspace_id, checkpoint_id, target_commit, previous_checkpoint_commit, {_AT} AS t_at FROM history_checkpoints), l AS (SELECT *, lag(target_commit) OVER (PARTITION BY workspace_id ORDER BY t_at NULLS FIRST, checkpoint_id) AS found FROM c) SELECT workspace_id, checkpoint_id, found AS previous_commit, previous_checkpoint_commit IS NOT DISTINCT FROM found AS as_told FROM l")
def ref_j14_previous_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint before each, by instant, and whether the row tells the same."""
    c = load(spark, d, "history_checkpoints").select("workspace_id", "checkpoint_id", "target_commit", "previous_checkpoint_commit", F.expr("try_cast(target_commit_timestamp AS timestamp_ltz)").alias("at")).distinct()
    found = F.lag("target_commit").over(Window.partitionBy("workspace_id").orderBy(F.col("at").asc_nulls_first(), "checkpoint_id"))
    return c.select("workspace_id", "checkpoint_id", found.alias("previous_commit"), "previous_checkpoint_commit").select("workspace_id", "checkpoint_id", "previous_commit", F.col("previous_checkpoint_commit").eqNullSafe(F.col("previous_commit")).alias("as_told"))


_SCORE = """3 * (previous_checkpoint_source IS NOT DISTINCT FROM 'explicit_override')::INT + 2 * (coalesce(changed, 0) > 0)::INT + 1 * (coalesce(changed, 0) + coalesce(added, 0) >= 10)::INT + 1 * (coalesce(added, 0) > 0)::INT + 1 * starts_with(coalesce(target_commit_subject, ''), 'Merge')::INT"""


@query(f"""WITH {_STANDING}, k AS (SELECT workspace_id, checkpoint_id, count(*) FILTER (WHERE change_kind = 'changed') AS changed, count(*) FILTER (WHERE change_kind = 'added') AS added FROM change GROUP BY ALL),
  c AS (SELECT DISTINCT workspace_id, checkpoint_id, previous_checkpoint_source, target_commit_subject FROM history_checkpoints)
  SELECT workspace_id, checkpoint_id, {_SCORE} AS score, CASE WHEN {_SCORE} >= 5 THEN 'primary' ELSE 'supporting' END AS recommendation,
    CASE WHEN previous_checkpoint_source IS NOT DISTINCT FROM 'explicit_override' THEN 'Tagged milestone' WHEN coalesce(added, 0) > 0 THEN 'New area' WHEN coalesce(changed, 0) > 0 THEN 'Interface boundary shift' ELSE target_commit_subject END AS title
  FROM c LEFT JOIN k USING (workspace_id, checkpoint_id)""")
def ref_a22_checkpoint_score(spark: SparkSession, d: str) -> DataFrame:
    """Score, recommendation and title (P27) of each checkpoint by what its snapshot shows."""
    h, g = _snap(spark, d)
    k = snapshot_changes(h, g).groupBy("workspace_id", "checkpoint_id").agg(F.count_if(F.col("change_kind") == "changed").alias("changed"), F.count_if(F.col("change_kind") == "added").alias("added"))
    c = h.select("workspace_id", "checkpoint_id", "previous_checkpoint_source", "target_commit_subject").distinct().join(k, ["workspace_id", "checkpoint_id"], "left").fillna(0, ["changed", "added"])
    tag, one = F.col("previous_checkpoint_source").eqNullSafe("explicit_override"), lambda x: x.cast("int")
    score = 3 * one(tag) + 2 * one(F.col("changed") > 0) + one(F.col("changed") + F.col("added") >= 10) + one(F.col("added") > 0) + one(F.coalesce("target_commit_subject", F.lit("")).startswith("Merge"))
    title = F.when(tag, "Tagged milestone").when(F.col("added") > 0, "New area").when(F.col("changed") > 0, "Interface boundary shift").otherwise(F.col("target_commit_subject"))
    return c.select("workspace_id", "checkpoint_id", score.alias("score"), F.when(score >= 5, "primary").otherwise("supporting").alias("recommendation"), title.alias("title"))


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY t_at DESC NULLS LAST, checkpoint_id DESC) AS back FROM (SELECT DISTINCT workspace_id, checkpoint_id, {_AT} AS t_at FROM history_checkpoints)),
  p AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY back = 1 DESC, checkpoint_id) AS n FROM c) SELECT workspace_id, checkpoint_id, back = 1 AS is_target FROM p WHERE n <= 12""")
def ref_t04_prompt_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Twelve candidates of each workspace, its newest checkpoint always among them."""
    c = load(spark, d, "history_checkpoints").select("workspace_id", "checkpoint_id", F.expr("try_cast(target_commit_timestamp AS timestamp_ltz)").alias("at")).distinct()
    back = c.withColumn("back", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("at").desc_nulls_last(), F.desc("checkpoint_id"))))
    w = Window.partitionBy("workspace_id").orderBy(F.desc(F.col("back") == 1), "checkpoint_id")
    return back.withColumn("n", F.row_number().over(w)).filter("n <= 12").select("workspace_id", "checkpoint_id", (F.col("back") == 1).alias("is_target"))


_SPANS = "span AS (SELECT DISTINCT csc_id, source_path, line_start AS a, line_end AS z FROM knowledge_chunks WHERE source_type = 'code' AND line_start IS NOT NULL AND line_end IS NOT NULL)"


@query(f"WITH {_SPANS}, m AS (SELECT *, max(z) OVER (PARTITION BY csc_id, source_path ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span), i AS (SELECT *, sum(CASE WHEN a <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY csc_id, source_path ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT csc_id, source_path, min(a) AS start, max(z) AS \"end\", count(*) AS spans FROM i GROUP BY csc_id, source_path, island")
def ref_w02_merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each file that its chunks cover, as few spans."""
    c = load(spark, d, "knowledge_chunks").filter("source_type = 'code' AND line_start IS NOT NULL AND line_end IS NOT NULL").select("csc_id", "source_path", F.col("line_start").alias("start"), F.col("line_end").alias("end")).distinct()
    return H.merged_spans(c, ["csc_id", "source_path"])


@query(f"WITH {_SPANS}, s AS (SELECT DISTINCT csc_id, path AS source_path, node_id AS excerpt, line_start AS xa, line_end AS xz FROM graph_nodes WHERE node_type = 'symbol' AND line_start IS NOT NULL AND line_end IS NOT NULL), m AS (SELECT s.csc_id, s.source_path, s.excerpt, s.xa, greatest(xa, a) AS start, least(xz, z) AS e, a AS segment, row_number() OVER (PARTITION BY s.csc_id, s.source_path, s.excerpt, s.xa, s.xz ORDER BY a, z) AS n FROM s JOIN span ON span.csc_id = s.csc_id AND span.source_path = s.source_path AND xa <= z AND xz >= a) SELECT csc_id, source_path, excerpt, start, e AS \"end\", segment FROM m WHERE n = 1 GROUP BY ALL")
def ref_j06_clipped(spark: SparkSession, d: str) -> DataFrame:
    """Symbols cut to the first chunk that they overlap."""
    ex = load(spark, d, "graph_nodes").filter("node_type = 'symbol' AND line_start IS NOT NULL AND line_end IS NOT NULL").select("csc_id", F.col("path").alias("source_path"), F.struct("node_id", "line_start", "line_end").alias("excerpt"), F.col("line_start").alias("a"), F.col("line_end").alias("z")).distinct()
    seg = load(spark, d, "knowledge_chunks").filter("source_type = 'code' AND line_start IS NOT NULL AND line_end IS NOT NULL").select("csc_id", "source_path", F.col("line_start").alias("segment"), F.col("line_start").alias("start"), F.col("line_end").alias("end")).distinct()
    return H.clipped(ex, seg, ["csc_id", "source_path"]).select("csc_id", "source_path", F.col("excerpt.node_id").alias("excerpt"), "start", "end", "segment").distinct()


@query("""WITH RECURSIVE u AS (SELECT csc_id, source_path, line_start, max(token_count) AS token_count FROM corpus_units GROUP BY csc_id, source_path, line_start), o AS (SELECT *, coalesce(token_count, 0) AS s, row_number() OVER (PARTITION BY csc_id ORDER BY source_path NULLS FIRST, line_start NULLS FIRST) AS i FROM u),
  w AS (SELECT csc_id, i, s::BIGINT AS load, 0::BIGINT AS bin FROM o WHERE i = 1 UNION ALL SELECT o.csc_id, o.i, CASE WHEN w.load > 0 AND (w.load + o.s > 8192 OR w.load >= 8192) THEN o.s ELSE w.load + o.s END, w.bin + (w.load > 0 AND (w.load + o.s > 8192 OR w.load >= 8192))::INT FROM w JOIN o ON o.csc_id = w.csc_id AND o.i = w.i + 1)
  SELECT csc_id, source_path, line_start, token_count, bin FROM o JOIN w USING (csc_id, i)""")
def ref_w05_greedy_bins(spark: SparkSession, d: str) -> DataFrame:
    """Units in order of their file in bins of 8,192 tokens, the next bin where one does not fit."""
    u = load(spark, d, "corpus_units").groupBy("csc_id", "source_path", "line_start").agg(F.max("token_count").alias("token_count"))
    return H.greedy_bins(u, "csc_id", ["source_path", "line_start"], "token_count", 8192)


@query("""WITH n AS (SELECT csc_id, path, unnest(functions) AS name, 1 AS kind FROM scan_records UNION SELECT csc_id, path, unnest(classes), 2 FROM scan_records),
  g AS (SELECT csc_id, name, min(kind) AS kind, count(DISTINCT path) AS modules FROM n WHERE length(name) >= 3 AND NOT starts_with(name, '_') GROUP BY ALL HAVING count(DISTINCT path) >= 2)
  SELECT csc_id, name, CASE kind WHEN 1 THEN 'function' ELSE 'class' END AS kind, modules FROM (SELECT *, row_number() OVER (PARTITION BY csc_id ORDER BY lower(name), name) AS n FROM g) WHERE n <= 6""")
def ref_a17_shared_names(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "scan_records")
    n = s.select("csc_id", "path", F.explode("functions").alias("name"), F.lit(1).alias("kind")).unionByName(s.select("csc_id", "path", F.explode("classes").alias("name"), F.lit(2).alias("kind")))
    g = n.filter("length(name) >= 3 AND NOT startswith(name, '_')").groupBy("csc_id", "name").agg(F.min("kind").alias("kind"), F.count_distinct("path").alias("modules")).filter("modules >= 2")
    w = Window.partitionBy("csc_id").orderBy(F.lower("name"), "name")
    return g.withColumn("n", F.row_number().over(w)).filter("n <= 6").select("csc_id", "name", F.when(F.col("kind") == 1, "function").otherwise("class").alias("kind"), "modules")


@query("WITH n AS (SELECT csc_id, path, unnest(functions) AS name FROM scan_records UNION SELECT csc_id, path, symbol_name FROM graph_nodes WHERE node_type = 'symbol') SELECT csc_id, phase, count(DISTINCT path) AS modules, count(DISTINCT name) AS names, min(name) AS first_name FROM n JOIN (VALUES " + ", ".join(f"('{p}')" for p in PHASES) + ") AS p(phase) ON contains(lower(name), phase) GROUP BY ALL")
def ref_a18_phases(spark: SparkSession, d: str) -> DataFrame:
    """Modules with functions or symbols named for a phase of work."""
    n = load(spark, d, "scan_records").select("csc_id", "path", F.explode("functions").alias("name")).unionByName(load(spark, d, "graph_nodes").filter("node_type = 'symbol'").select("csc_id", "path", F.col("symbol_name").alias("name")))
    hit = F.explode(F.filter(F.array(*map(F.lit, PHASES)), lambda p: F.contains(F.lower("name"), p)))
    return n.select("csc_id", "path", "name", hit.alias("phase")).groupBy("csc_id", "phase").agg(F.count_distinct("path").alias("modules"), F.count_distinct("name").alias("names"), F.min("name").alias("first_name"))


@query("""WITH r AS (SELECT csc_id, edge_id, target_id FROM graph_edges WHERE edge_type = 'documents' AND target_id IS NOT NULL GROUP BY ALL) SELECT r.csc_id, r.edge_id, 'unknown_concept_reference' AS check_id, r.target_id AS reference FROM r
  ANTI JOIN (SELECT DISTINCT csc_id, node_id AS target_id FROM graph_nodes) n USING (csc_id, target_id)""")
def ref_v02_unknown_references(spark: SparkSession, d: str) -> DataFrame:
    """References of sections to nodes that no table knows."""
    r = load(spark, d, "graph_edges").filter("edge_type = 'documents' AND target_id IS NOT NULL").select("csc_id", "edge_id", "target_id").distinct()
    n = load(spark, d, "graph_nodes").select("csc_id", F.col("node_id").alias("target_id")).distinct()
    return r.join(n, ["csc_id", "target_id"], "left_anti").select("csc_id", "edge_id", F.lit("unknown_concept_reference").alias("check_id"), F.col("target_id").alias("reference"))


@query("""WITH u AS (SELECT DISTINCT csc_id, source_path AS path FROM corpus_units WHERE csc_id NOT LIKE 'csc-archive-%'), s AS (SELECT DISTINCT csc_id, path FROM scan_records)
  SELECT csc_id, count(*) FILTER (WHERE u.path IS NOT NULL AND s.path IS NOT NULL) AS in_both, count(*) FILTER (WHERE s.path IS NULL) AS only_units, count(*) FILTER (WHERE u.path IS NULL) AS only_files FROM u FULL JOIN s USING (csc_id, path) GROUP BY ALL""")
def ref_u07_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Files of the corpus against scanned files of each repository."""
    u = load(spark, d, "corpus_units").filter("csc_id NOT LIKE 'csc-archive-%'").select("csc_id", F.col("source_path").alias("path"), F.lit(True).alias("u")).distinct()
    s = load(spark, d, "scan_records").select("csc_id", "path", F.lit(True).alias("s")).distinct()
    j = u.join(s, ["csc_id", "path"], "full_outer")
    return j.groupBy("csc_id").agg(F.count_if(F.col("u") & F.col("s")).alias("in_both"), F.count_if(F.col("s").isNull()).alias("only_units"), F.count_if(F.col("u").isNull()).alias("only_files"))


_RAW = ("4", "5/5", " 3 ", "7", "true", "n/a", "", "-1", "2 of 5", "10")


@query("SELECT raw, CASE WHEN raw = 'true' THEN 1 WHEN raw = '-1' THEN 0 WHEN regexp_matches(t, '^[0-9]+$') THEN least(5, t::INT) WHEN regexp_matches(t, '^[0-9]') THEN least(5, left(t, 1)::INT) END AS score FROM (SELECT raw, trim(raw) AS t FROM (VALUES " + ", ".join(f"('{x}')" for x in _RAW) + ") AS v(raw))")
def ref_v22_judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores from whatever a judge wrote: numbers and booleans, or the leading digit, between 0 and 5."""
    t, number = F.trim("raw"), F.expr("try_cast(trim(raw) AS double)")
    score = F.when(F.lower(t) == "true", 1).when(F.lower(t) == "false", 0).when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), F.bround(number).cast("int")))).when(t.rlike("^[0-9]"), F.least(F.lit(5), F.substring(t, 1, 1).cast("int")))
    return spark.createDataFrame([(x,) for x in _RAW], "raw string").select("raw", score.alias("score"))
