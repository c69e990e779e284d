"""Queries over chunks, questions and their fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.text import bucket, keywords, tokens
from repolith.operators import retrieval as R
from repolith.session import cut, load

QUERIES, SQL = {}, {}
Questions = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.chunk_rows(load(spark, d, "knowledge_chunks"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Commit subjects, asked of the repository of the workspace's number."""
    return load(spark, d, "history_checkpoints").filter("target_commit_subject IS NOT NULL").select(
        F.concat(F.lit("csc"), F.substring("workspace_id", 3, 99)).alias("csc_id"), F.col("checkpoint_id").alias("question_id"), F.col("target_commit_subject").alias("question")).distinct()


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts of every twentieth document by its number, asked of the document's own repository."""
    return load(spark, d, "documents").filter("doc_id % 20 = 0 AND csc_id IS NOT NULL AND text IS NOT NULL").groupBy("csc_id", F.col("doc_id").cast("string").alias("question_id")).agg(F.min("text").alias("question"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return R.indexed(load(spark, d, "knowledge_chunks"))


_TOK = "list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))"
_BASE = f"""
chunk AS (SELECT csc_id, chunk_id, c.source_type AS source_type, c.source_path AS source_path, c.text AS text, c.section_id AS section_id, c.line_start AS line_start, c.line_end AS line_end
          FROM (SELECT csc_id, chunk_id, min({{'source_type': source_type, 'source_path': source_path, 'text': text, 'section_id': section_id, 'line_start': line_start, 'line_end': line_end}}) AS c FROM knowledge_chunks GROUP BY ALL)),
tf AS (SELECT csc_id, chunk_id, term, count(*) AS tf FROM (SELECT csc_id, chunk_id, unnest({_TOK.format('text')}) AS term FROM chunk) GROUP BY ALL),
len AS (SELECT csc_id, chunk_id, len({_TOK.format('text')}) AS dl FROM chunk),
stats AS (SELECT csc_id, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY csc_id),
df AS (SELECT csc_id, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT 'csc' || substr(workspace_id, 3) AS csc_id, checkpoint_id AS question_id, target_commit_subject AS question FROM history_checkpoints WHERE target_commit_subject IS NOT NULL),
asked AS (SELECT csc_id, question_id, unnest({_TOK.format('question')}) AS term FROM q),
scores AS (
  SELECT csc_id, question_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM asked JOIN tf USING (csc_id, term) JOIN df USING (csc_id, term) JOIN stats USING (csc_id) JOIN len USING (csc_id, chunk_id) GROUP BY ALL HAVING score > 0),
best AS (SELECT s.*, row_number() OVER (PARTITION BY csc_id, question_id ORDER BY score DESC, source_path, coalesce(line_start, 0), chunk_id) AS rank FROM scores s JOIN chunk USING (csc_id, chunk_id)),
first AS (SELECT csc_id, chunk_id, row_number() OVER (PARTITION BY csc_id ORDER BY source_path, coalesce(line_start, 0), chunk_id) AS rank FROM chunk),
top AS (
  SELECT csc_id, question_id, rank, chunk_id, score FROM best WHERE rank <= 6
  UNION ALL
  SELECT q.csc_id, q.question_id, f.rank, f.chunk_id, 0.0 FROM q JOIN first f USING (csc_id) WHERE f.rank <= 6 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.csc_id = q.csc_id AND b.question_id = q.question_id))"""
_WITH = "WITH " + _BASE + " "


def _case(table: dict[str, list[str]], column: str) -> str:
    return "CASE " + " ".join(f"WHEN list_has_any({column}, [{', '.join(repr(x) for x in words)}]) THEN '{name}'" for name, words in table.items()) + " ELSE 'implementation' END"


_INTENT = _case(R.INTENT_WORDS, _TOK.format("question"))
_BIAS = "CASE intent || '/' || source_type " + " ".join(f"WHEN '{i}/{s}' THEN {v}" for (i, s), v in R.TYPE_BIAS.items()) + " ELSE 0.01 END"


@query(_WITH + f"SELECT csc_id, chunk_id, {_TOK.format('text')} AS tokens FROM chunk")
def ref_p01_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("csc_id", "chunk_id", tokens(F.col("text")).alias("tokens"))


@query(_WITH + f"""SELECT csc_id, chunk_id, (SELECT list(t ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest({_TOK.format('text')}) AS t, generate_subscripts({_TOK.format('text')}, 1) AS i) GROUP BY t ORDER BY i LIMIT 8)) AS keywords
  FROM chunk WHERE len({_TOK.format('text')}) > 0""")
def ref_p02_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("csc_id", "chunk_id", keywords(F.col("text")).alias("keywords")).filter(F.size("keywords") > 0)


@query(_WITH + """SELECT csc_id, chunk_id, source_path, line_start, line_end, CASE WHEN length(flat) > 200 THEN regexp_replace(substr(flat, 1, 200), '\\s+$', '') || '...' ELSE flat END AS quote
  FROM (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS flat FROM chunk)""")
def ref_p06_citations(spark: SparkSession, d: str) -> DataFrame:
    return R.citations(_chunks(spark, d))


@query(_WITH + "SELECT csc_id, term, (('0x' || right(md5(term), 2))::INTEGER % 64)::INTEGER AS bucket FROM df")
def ref_p21_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.document_frequencies(_index(spark, d)).select("csc_id", "term", bucket(F.col("term")).alias("bucket"))


@query(_WITH + "SELECT ('0x' || right(md5(term), 2))::INTEGER % 64 AS bucket, count(*) AS postings, count(DISTINCT term) AS terms FROM tf GROUP BY 1")
def ref_s12_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(_index(spark, d)).groupBy("bucket").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))


@query(_WITH + "SELECT * FROM tf")
def ref_a01_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return R.term_frequencies(_index(spark, d))


@query(_WITH + "SELECT csc_id, n, round(avgdl, 9) AS avgdl, (SELECT count(*) FROM df WHERE df.csc_id = stats.csc_id) AS terms FROM stats")
def ref_a02_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _index(spark, d)
    terms = R.document_frequencies(c).groupBy("csc_id").agg(F.count("*").alias("terms"))
    return R.corpus_stats(c).join(terms, "csc_id", "left").select("csc_id", "n", F.round("avgdl", 9).alias("avgdl"), F.coalesce("terms", F.lit(0)).alias("terms"))


@query(_WITH + "SELECT * FROM scores")
def ref_a03_bm25(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    return R.bm25(_index(spark, d), questions(spark, d))


@query(_WITH + "SELECT a.csc_id, a.question_id, a.term, t.chunk_id, t.tf FROM asked a JOIN tf t USING (csc_id, term)")
def ref_j01_posting_lookup(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    asked = questions(spark, d).select("csc_id", "question_id", F.explode(tokens(F.col("question"))).alias("term"))
    return asked.join(R.term_frequencies(_index(spark, d)), ["csc_id", "term"]).select("csc_id", "question_id", "term", "chunk_id", "tf")


@query(_WITH + "SELECT csc_id, question_id, chunk_id, dl FROM scores JOIN len USING (csc_id, chunk_id)")
def ref_j02_doc_lengths(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    """Lengths of the chunks that share a token with a question; the terms asked for are looked up, nothing is scored."""
    posted = _index(spark, d).select("csc_id", "chunk_id", "dl", F.explode(F.array_distinct("words")).alias("term"))
    return R.asked_terms(questions(spark, d)).join(posted, ["csc_id", "term"]).select("csc_id", "question_id", "chunk_id", "dl").distinct()


@query(_WITH + "SELECT * FROM top")
def ref_t01_top_k(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    return R.top_k(load(spark, d, "knowledge_chunks"), questions(spark, d))


@query(_WITH + "SELECT csc_id, question_id, chunk_id, rank FROM best WHERE rank <= 3")
def ref_w01_rank(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    return R.top_k(_index(spark, d), questions(spark, d), 3).filter("score > 0").select("csc_id", "question_id", "chunk_id", "rank")


@query(_WITH + f"SELECT csc_id, question_id, {_INTENT} AS intent FROM q UNION ALL SELECT suite, item_id::VARCHAR, {_INTENT} FROM (SELECT DISTINCT suite, item_id, prompt AS question FROM eval_items)")
def ref_f04_intent(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "eval_items").select(F.col("suite").alias("csc_id"), F.col("item_id").cast("string").alias("question_id"), F.col("prompt").alias("question")).distinct()
    return _questions(spark, d).unionByName(items).select("csc_id", "question_id", R.intent(F.col("question")).alias("intent"))


_EDGE_ROWS = ", ".join(f"('{i}', '{e}')" for i, es in R.INTENT_EDGES.items() for e in es)


@query(f"SELECT intent, csc_id, count(*) AS edges FROM (SELECT DISTINCT csc_id, edge_id, edge_type FROM graph_edges) JOIN (VALUES {_EDGE_ROWS}) AS t(intent, edge_type) USING (edge_type) GROUP BY ALL")
def ref_f05_intent_edges(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(i, e) for i, es in R.INTENT_EDGES.items() for e in es], "intent string, edge_type string")
    edges = load(spark, d, "graph_edges").select("csc_id", "edge_id", "edge_type").distinct()
    return edges.join(F.broadcast(rules), "edge_type").groupBy("intent", "csc_id").agg(F.count("*").alias("edges"))


@query(_WITH + """SELECT csc_id, source_path, chunk_id, rank FROM (SELECT c.csc_id, c.source_path, c.chunk_id, row_number() OVER (PARTITION BY c.csc_id, c.source_path ORDER BY coalesce(line_start, 0), chunk_id) AS rank
  FROM chunk c WHERE EXISTS (SELECT 1 FROM dependency_records r WHERE r.csc_id = c.csc_id AND r.target_path = c.source_path)) WHERE rank <= 5""")
def ref_f03_chunks_by_path(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    wanted = load(spark, d, "dependency_records").select("csc_id", F.col("target_path").alias("source_path")).filter("source_path IS NOT NULL").distinct()
    w = Window.partitionBy("csc_id", "source_path").orderBy(F.coalesce("line_start", F.lit(0)), "chunk_id")
    return _chunks(spark, d).join(wanted, ["csc_id", "source_path"], "left_semi").select("csc_id", "source_path", "chunk_id", F.row_number().over(w).alias("rank")).filter("rank <= 5")


_FUSED = """
top12 AS (SELECT csc_id, question_id, chunk_id, score FROM best WHERE rank <= 12),
intents AS (SELECT csc_id, question_id, """ + _INTENT + """ AS intent FROM q),
named AS (SELECT DISTINCT t.csc_id, t.question_id, c.source_path FROM top t JOIN chunk c USING (csc_id, chunk_id) WHERE t.rank = 1 AND t.score > 0),
graph AS (
  SELECT n.csc_id, n.question_id, c.chunk_id, 1.0 AS graph_score FROM named n
  JOIN (SELECT DISTINCT csc_id, source_path, target_path FROM dependency_records WHERE target_path IS NOT NULL) r USING (csc_id, source_path)
  JOIN chunk c ON c.csc_id = n.csc_id AND c.source_path = r.target_path GROUP BY ALL),
pool AS (
  SELECT coalesce(l.csc_id, g.csc_id) AS csc_id, coalesce(l.question_id, g.question_id) AS question_id, coalesce(l.chunk_id, g.chunk_id) AS chunk_id,
         l.score / max(l.score) OVER (PARTITION BY coalesce(l.csc_id, g.csc_id), coalesce(l.question_id, g.question_id)) AS lex, g.graph_score
  FROM top12 l FULL JOIN graph g ON l.csc_id = g.csc_id AND l.question_id = g.question_id AND l.chunk_id = g.chunk_id),
rated AS (
  SELECT p.csc_id, p.question_id, p.chunk_id, c.source_path, c.line_start, round(coalesce(lex, 0), 6) AS lexical_score, CASE WHEN a.source_path IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS anchor_score,
         coalesce(graph_score, 0)::DOUBLE AS graph_score, (""" + _BIAS + """)::DOUBLE AS type_bias, CASE WHEN graph_score IS NULL THEN 'lexical' WHEN lex IS NULL THEN 'graph' ELSE 'lexical+graph' END AS reason
  FROM pool p JOIN intents USING (csc_id, question_id) JOIN chunk c ON c.csc_id = p.csc_id AND c.chunk_id = p.chunk_id LEFT JOIN named a ON a.csc_id = p.csc_id AND a.question_id = p.question_id AND a.source_path = c.source_path),
final AS (SELECT *, round(0.65::DOUBLE * lexical_score + 0.2::DOUBLE * anchor_score + 0.15::DOUBLE * graph_score + type_bias, 6) AS final_score FROM rated),
ranked AS (SELECT *, row_number() OVER (PARTITION BY csc_id, question_id ORDER BY final_score DESC, source_path, coalesce(line_start, 0), chunk_id) AS rank FROM final)"""


def _fusion(spark: SparkSession, d: str, asked: Questions) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    chunks, questions = _index(spark, d), asked(spark, d)
    top = cut(R.top_k(chunks, questions, 12).filter("score > 0"))
    anchors = top.filter("rank = 1").join(chunks.select("csc_id", "chunk_id", "source_path"), ["csc_id", "chunk_id"]).select("csc_id", "question_id", "source_path")
    imports = load(spark, d, "dependency_records").filter("target_path IS NOT NULL").select("csc_id", "source_path", "target_path").distinct()
    graph = anchors.join(imports, ["csc_id", "source_path"]).select("csc_id", "question_id", F.col("target_path").alias("source_path")).distinct().join(
        chunks.select("csc_id", "source_path", "chunk_id"), ["csc_id", "source_path"]).select("csc_id", "question_id", "chunk_id", F.lit(1.0).alias("graph_score"))
    return top.select("csc_id", "question_id", "chunk_id", "score"), graph, chunks, questions, anchors


@query("WITH " + _BASE + "," + _FUSED + " SELECT csc_id, question_id, rank, chunk_id, lexical_score, anchor_score, graph_score, type_bias, final_score, reason FROM ranked WHERE rank <= 12")
def ref_r01_rerank(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    return R.rerank(*_fusion(spark, d, questions))


@query("WITH " + _BASE + "," + _FUSED + """ SELECT csc_id, question_id, chunk_id, source, score FROM (
  SELECT *, row_number() OVER (PARTITION BY csc_id, question_id, chunk_id ORDER BY CASE source WHEN 'lexical' THEN 1 ELSE 2 END, score DESC) AS n
  FROM (SELECT csc_id, question_id, chunk_id, 'lexical' AS source, score FROM top12 UNION ALL SELECT csc_id, question_id, chunk_id, 'hierarchy', graph_score FROM graph)) WHERE n = 1""")
def ref_u02_prior_source(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    lexical, graph, *_ = _fusion(spark, d, questions)
    both = lexical.select("*", F.lit("lexical").alias("source")).unionByName(graph.select("csc_id", "question_id", "chunk_id", F.col("graph_score").alias("score"), F.lit("hierarchy").alias("source")))
    return R.prior_source(both)


@query("WITH " + _BASE + "," + _FUSED + " SELECT g.csc_id, g.question_id, g.chunk_id FROM graph g ANTI JOIN top12 USING (csc_id, question_id, chunk_id)")
def ref_u04_graph_only(spark: SparkSession, d: str, questions: Questions = _questions) -> DataFrame:
    lexical, graph, *_ = _fusion(spark, d, questions)
    return graph.select("csc_id", "question_id", "chunk_id").join(lexical, ["csc_id", "question_id", "chunk_id"], "left_anti")


@query(_WITH + "SELECT csc_id, source_type, count(*) AS chunks, sum(dl)::BIGINT AS tokens FROM chunk JOIN len USING (csc_id, chunk_id) GROUP BY ALL")
def ref_u06_chunk_streams(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    parts = [c.filter(F.col("source_type").isin("sdd_section", "review_artifact")), c.filter(F.col("source_type").isin("file_summary", "directory_summary")), c.filter("source_type = 'code'")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("csc_id", "source_type").agg(F.count("*").alias("chunks"), F.sum(F.size(tokens(F.col("text")))).alias("tokens"))


@query("""WITH k AS (SELECT DISTINCT csc_id, chunk_id, source_type FROM knowledge_chunks), n AS (SELECT csc_id, chunk_id, 'new' AS source_type FROM k WHERE source_type = 'code')
  SELECT * FROM n UNION ALL SELECT * FROM k ANTI JOIN n USING (csc_id, chunk_id)""")
def ref_t02_index_update(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "knowledge_chunks").select("csc_id", "chunk_id", "source_type").distinct()
    return R.upsert(old, old.filter("source_type = 'code'").withColumn("source_type", F.lit("new")), ["csc_id", "chunk_id"])


_OF_COMMITS = "q AS (SELECT DISTINCT 'csc' || substr(workspace_id, 3) AS csc_id, checkpoint_id AS question_id, target_commit_subject AS question FROM history_checkpoints WHERE target_commit_subject IS NOT NULL),"
_OF_DOCUMENTS = "q AS (SELECT csc_id, doc_id::VARCHAR AS question_id, min(text) AS question FROM documents WHERE doc_id % 20 = 0 AND csc_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),"


def _ask_documents(search: Callable[..., DataFrame]) -> None:
    """Register a search a second time, as NAME_documents, with the questions of _documents."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return search(spark, d, _documents)

    run.__name__ = f"{search.__name__}_documents"
    query(SQL[search.__name__].replace(_OF_COMMITS, _OF_DOCUMENTS))(run)


for _search in (ref_a03_bm25, ref_j01_posting_lookup, ref_j02_doc_lengths, ref_t01_top_k, ref_w01_rank, ref_r01_rerank, ref_u02_prior_source, ref_u04_graph_only):
    _ask_documents(_search)


_EXPANDED = _WITH + """, links AS (SELECT DISTINCT csc_id, source_id AS parent, target_id AS child FROM graph_edges WHERE edge_type IN ('contains', 'parent_of') AND source_id IS NOT NULL AND target_id IS NOT NULL),
  summary AS (SELECT DISTINCT csc_id, metadata['node_id'] AS node_id, chunk_id, source_type, source_path FROM knowledge_chunks WHERE source_type IN ('file_summary', 'directory_summary') AND metadata['node_id'] IS NOT NULL),
  init AS (SELECT csc_id, question_id, chunk_id, rank FROM top), seed AS (SELECT DISTINCT i.csc_id, i.question_id, CASE WHEN c.source_type = 'code' THEN 'file::' || c.source_path ELSE s.node_id END AS node_id FROM init i JOIN chunk c USING (csc_id, chunk_id) LEFT JOIN summary s USING (csc_id, chunk_id) WHERE c.source_type = 'code' OR s.node_id IS NOT NULL),
  up AS (SELECT DISTINCT s.csc_id, s.question_id, l.parent FROM seed s JOIN links l ON l.csc_id = s.csc_id AND l.child = s.node_id), heads AS (SELECT * FROM up UNION SELECT csc_id, question_id, node_id FROM seed),
  near AS (SELECT h.csc_id, h.question_id, l.child AS node_id FROM heads h JOIN links l USING (csc_id, parent) UNION SELECT csc_id, question_id, parent FROM up),
  fresh AS (SELECT n.csc_id, n.question_id, n.node_id, s.chunk_id, s.source_type, s.source_path FROM near n JOIN summary s USING (csc_id, node_id) WHERE NOT EXISTS (SELECT 1 FROM seed e WHERE e.csc_id = n.csc_id AND e.question_id = n.question_id AND e.node_id = n.node_id) AND NOT EXISTS (SELECT 1 FROM init i WHERE i.csc_id = n.csc_id AND i.question_id = n.question_id AND i.chunk_id = s.chunk_id)),
  own AS (SELECT csc_id, question_id, count(*) AS own FROM init GROUP BY ALL), ranked_ AS (SELECT f.*, own + row_number() OVER (PARTITION BY f.csc_id, f.question_id ORDER BY CASE source_type WHEN 'directory_summary' THEN 0 ELSE 1 END, source_path, chunk_id, node_id) AS rank FROM fresh f JOIN own USING (csc_id, question_id))
  SELECT csc_id, question_id, rank, chunk_id, 'initial' AS origin FROM init UNION ALL SELECT csc_id, question_id, rank, chunk_id, 'hierarchy' FROM ranked_ WHERE rank <= 12"""


@query(_EXPANDED)
def ref_u03_hierarchy_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The chunks found for each question, and the summaries around them in the hierarchy, twelve in all."""
    index, raw = _index(spark, d), load(spark, d, "knowledge_chunks")
    initial = R.top_k(index, _questions(spark, d)).select("csc_id", "question_id", "chunk_id", "rank")
    summaries = raw.filter("source_type IN ('file_summary', 'directory_summary') AND metadata['node_id'] IS NOT NULL").select("csc_id", F.col("metadata")["node_id"].alias("node_id"), "chunk_id", "source_type", "source_path").distinct()
    found = initial.join(index.select("csc_id", "chunk_id", "source_type", "source_path"), ["csc_id", "chunk_id"]).join(summaries.select("csc_id", "chunk_id", "node_id"), ["csc_id", "chunk_id"], "left")
    seeds = found.select("csc_id", "question_id", F.when(F.col("source_type") == "code", F.concat(F.lit("file::"), "source_path")).otherwise(F.col("node_id")).alias("node_id")).filter("node_id IS NOT NULL").distinct()
    links = load(spark, d, "graph_edges").filter("edge_type IN ('contains', 'parent_of') AND source_id IS NOT NULL AND target_id IS NOT NULL").select("csc_id", F.col("source_id").alias("parent"), F.col("target_id").alias("child")).distinct()
    return R.expanded(initial, seeds, links, summaries)
