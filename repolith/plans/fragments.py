"""Queries on fragments of the graph, anchors, owners and symbols with spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.operators import analyzers
from repolith.operators import fragments as G
from repolith.operators import repository as P
from repolith.operators import retrieval as R
from repolith.plans.repository import _LANGUAGE, _NODES, _UP
from repolith.plans.retrieval import _BASE, _FUSED, _TOK, _fusion, _index, _questions
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [load(spark, d, {"scan": "scan_records", "nodes": "graph_nodes", "edges": "graph_edges", "deps": "dependency_records", "chunks": "knowledge_chunks"}[n]) for n in names]


#: Small texts of every language and the symbols that stand in them, by hand: path, kind, qualified name, first and last line.
TEXTS = {
    "a/x.py": "class A:\n    def f(self):\n        def g():\n            pass\n        return g\n\ndef h():\n    pass\n",
    "B.java": "package a;\npublic class B {\n  int x;\n  // class No {\n  public int f(int a) {\n    return a;\n  }\n  static class C {\n    void g() {\n    }\n  }\n}\n",
    "c.cpp": "#include <x>\nstruct P {\n  int f(int a) {\n    return a;\n  }\n};\nint P::g(int b) {\n  return b;\n}\n", "d.go": "package d\n\ntype S struct {\n\tA int\n}\n\nfunc (s *S) Get() int {\n\treturn s.A\n}\n\nfunc New() *S {\n\treturn nil\n}\n",
    "e.rs": "pub struct R { x: i64 }\nimpl R {\n    pub fn get(&self) -> i64 {\n        self.x\n    }\n}\nfn main() {\n}\n", "f.ts": "export class K {\n  run(a: number): void {\n  }\n}\nexport function z(b: string) {\n  return b;\n}\n",
    "g.js": "class J {\n  go(a) {\n  }\n}\nfunction top(x) {\n  return `class No {`;\n}\n", "H.cs": "namespace N {\n  public interface H {\n  }\n  public class I {\n    public int F(int a) {\n      return a;\n    }\n  }\n}\n", "n.txt": "def no(): pass\n", "bad.py": "class Q:\n  def r(self:\n    pass\nx = 1\n",
}
SYMBOLS = [
    ("a/x.py", "class", "A", 1, 5), ("a/x.py", "method", "A.f", 2, 5), ("a/x.py", "function", "A.f.g", 3, 4), ("a/x.py", "function", "h", 7, 8), ("a/x.py", "module", "x", 1, 8),
    ("B.java", "class", "B", 2, 12), ("B.java", "method", "B.f", 5, 7), ("B.java", "class", "B.C", 8, 11), ("B.java", "method", "B.C.g", 9, 10), ("B.java", "module", "B", 1, 12),
    ("c.cpp", "struct", "P", 2, 6), ("c.cpp", "method", "P.f", 3, 5), ("c.cpp", "method", "P.g", 7, 9), ("c.cpp", "module", "c", 1, 9), ("d.go", "struct", "S", 3, 5), ("d.go", "method", "S.Get", 7, 9), ("d.go", "function", "New", 11, 13), ("d.go", "module", "d", 1, 13),
    ("e.rs", "struct", "R", 1, 1), ("e.rs", "impl", "R", 2, 6), ("e.rs", "method", "R.get", 3, 5), ("e.rs", "function", "main", 7, 8), ("e.rs", "module", "e", 1, 8), ("f.ts", "class", "K", 1, 4), ("f.ts", "method", "K.run", 2, 3), ("f.ts", "function", "z", 5, 7), ("f.ts", "module", "f", 1, 7),
    ("g.js", "class", "J", 1, 4), ("g.js", "method", "J.go", 2, 3), ("g.js", "function", "top", 5, 7), ("g.js", "module", "g", 1, 7), ("H.cs", "interface", "H", 2, 3), ("H.cs", "class", "I", 4, 8), ("H.cs", "method", "I.F", 5, 7), ("H.cs", "module", "H", 1, 9),
    ("bad.py", "class", "Q", 1, 3), ("bad.py", "method", "Q.r", 2, 3), ("bad.py", "module", "bad", 1, 4),
]


@query("SELECT * FROM (VALUES " + ", ".join(str(x) for x in SYMBOLS) + ") AS v(path, kind, qualified_name, line_start, line_end)")
def ref_x01_small_texts(spark: SparkSession, d: str) -> DataFrame:
    """Nested symbols with spans of one small text of every language (X1, X2, X4); constants, not a table."""
    files = spark.createDataFrame([("demo", p, t) for p, t in TEXTS.items()], "csc_id string, path string, text string")
    return analyzers.symbols(files).select("path", "kind", "qualified_name", "line_start", "line_end")


@query()
def ref_x01_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Nested symbols with spans of every scanned text."""
    return analyzers.symbols(load(spark, d, "scan_records"))


@query(f"WITH s AS (SELECT DISTINCT csc_id, path FROM scan_records WHERE path IS NOT NULL AND text IS NOT NULL AND {_LANGUAGE} = 'python' AND NOT regexp_matches(text, '(^|\\n)[ \\t]*(async +)?(def|class)\\b')) SELECT csc_id, path, 0 AS symbols FROM s ANTI JOIN (SELECT csc_id, path FROM scan_records WHERE regexp_matches(text, '\\b(def|class)\\b')) USING (csc_id, path)")
def ref_x01_files_without_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Python files in whose scans no declaring word stands, with the symbols found in them."""
    f = load(spark, d, "scan_records").filter("path IS NOT NULL AND text IS NOT NULL").filter(P.language_of(F.col("path")) == "python")
    worded = f.groupBy("csc_id", "path").agg(F.max(F.col("text").rlike(r"\b(def|class)\b")).alias("w")).filter("NOT w").select("csc_id", "path")
    found = analyzers.symbols(f).groupBy("csc_id", "path").agg(F.count("*").alias("symbols"))
    return worded.join(found, ["csc_id", "path"], "left").select("csc_id", "path", F.coalesce("symbols", F.lit(0)).cast("int").alias("symbols"))


_KNOWN = "known AS (SELECT DISTINCT csc_id, path FROM scan_records WHERE path IS NOT NULL)"
_SYM = "sym AS (SELECT DISTINCT csc_id, path, node_id AS symbol, symbol_kind AS kind, symbol_name AS name, coalesce(qualified_name, symbol_name) AS qualified, line_start AS line FROM graph_nodes WHERE node_type = 'symbol' AND path IS NOT NULL AND symbol_name IS NOT NULL)"
_OWNERS = r"own1 AS (SELECT csc_id, path, qualified, min(struct_pack(m := coalesce(kind, '') = 'module', s := symbol)) AS f FROM {0} GROUP BY ALL), own AS (SELECT DISTINCT m.csc_id, m.path, o.f.s AS owner, m.symbol AS member FROM {0} m JOIN own1 o ON o.csc_id = m.csc_id AND o.path = m.path AND o.qualified = regexp_replace(m.qualified, '\.[^.]*$', '') WHERE contains(m.qualified, '.') AND o.f.s <> m.symbol)"


@query(f"WITH {_SYM}, {_OWNERS.format('sym')} SELECT * FROM own")
def ref_j10_owners(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and the ones that their qualified names put them under, modules last."""
    return G.owners(G.symbol_rows(load(spark, d, "graph_nodes")))


_CODE = "code AS (SELECT DISTINCT csc_id, source_path AS path, chunk_id, line_start, line_end, text FROM knowledge_chunks WHERE source_type = 'code')"
_REFS = f"refs AS (SELECT c.csc_id, c.path, c.chunk_id, s.symbol FROM code c JOIN {{0}} s ON s.csc_id = c.csc_id AND s.path = c.path WHERE s.line BETWEEN c.line_start AND c.line_end UNION SELECT c.csc_id, c.path, c.chunk_id, s.symbol FROM (SELECT csc_id, path, chunk_id, unnest({_TOK.format('text')}) AS low FROM code) c JOIN {{0}} s ON s.csc_id = c.csc_id AND s.path = c.path AND lower(s.name) = c.low)"


@query(f"""WITH {_KNOWN}, {_SYM}, ks AS (SELECT sym.* FROM sym SEMI JOIN known USING (csc_id, path)), {_OWNERS.format('ks')}, {_CODE}, {_REFS.format('ks')}
  SELECT csc_id, 'file::' || path AS fragment_id, unnest(['contains', 'defines']) AS edge_type, 'file::' || path AS source_id, symbol AS target_id FROM ks UNION SELECT csc_id, 'file::' || path, unnest(['contains', 'parent_of']), owner, member FROM own
  UNION SELECT r.csc_id, 'file::' || r.source_path, 'imports', 'file::' || r.source_path, 'file::' || r.target_path FROM dependency_records r JOIN known a ON a.csc_id = r.csc_id AND a.path = r.source_path JOIN known b ON b.csc_id = r.csc_id AND b.path = r.target_path WHERE r.source_path <> r.target_path
  UNION SELECT code.csc_id, 'file::' || path, 'contains', 'file::' || path, 'chunk::' || chunk_id FROM code SEMI JOIN known USING (csc_id, path) UNION SELECT csc_id, 'file::' || path, 'references', 'chunk::' || chunk_id, symbol FROM refs""")
def ref_g02_file_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The edges of every file's fragment: symbols, ownership, imports, chunks and references."""
    return G.file_fragments(*_t(spark, d, "scan", "nodes", "deps", "chunks"))


@query(f"""WITH {_KNOWN}, {_SYM}, tg AS (SELECT csc_id, 'file::' || path AS id FROM known UNION SELECT csc_id, symbol FROM sym), e AS (SELECT DISTINCT csc_id, edge_type, source_id, target_id FROM graph_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
  docs AS (SELECT e.* FROM e JOIN tg ON tg.csc_id = e.csc_id AND tg.id = e.target_id WHERE edge_type = 'documents' AND source_id LIKE 'sdd_section::%'), ch AS (SELECT e.* FROM e JOIN known k ON k.csc_id = e.csc_id AND 'file::' || k.path = e.source_id WHERE edge_type = 'changed_in' AND target_id LIKE 'commit::%')
  SELECT DISTINCT csc_id, 'misc' AS fragment_id, NULL AS edge_type, 'chunk::' || chunk_id AS source_id, NULL AS target_id FROM knowledge_chunks WHERE source_type <> 'code' UNION ALL SELECT csc_id, source_id, edge_type, source_id, target_id FROM docs UNION ALL SELECT csc_id, target_id, edge_type, source_id, target_id FROM ch
  UNION ALL SELECT DISTINCT c.csc_id, c.target_id, 'impacts_section', c.target_id, d.source_id FROM ch c JOIN docs d ON d.csc_id = c.csc_id AND d.target_id = c.source_id""")
def ref_g03_other_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of other chunks, of sections and of commits."""
    return G.other_fragments(*_t(spark, d, "scan", "nodes", "edges", "chunks"))


_S = "coalesce({0}::VARCHAR, '')"
_CHUNK_ROW = f"'chunk' || '|' || {_S.format('chunk_id')} || '|' || {_S.format('source_type')} || '|' || {_S.format('line_start')} || '|' || {_S.format('line_end')} || '|' || sha256({_S.format('text')})"
_LIST = "array_to_string(coalesce({0}, []), ',')"


@query(f"""WITH r AS (SELECT csc_id, 'structure' AS fragment_id, path || '|' || {_LANGUAGE} AS row FROM scan_records WHERE path IS NOT NULL
    UNION SELECT csc_id, 'file::' || path, 'scan' || '|' || {_S.format('language')} || '|' || {_LIST.format('functions')} || '|' || {_LIST.format('classes')} || '|' || {_LIST.format('imports')} || '|' || sha256({_S.format('text')}) FROM scan_records WHERE path IS NOT NULL
    UNION SELECT csc_id, 'file::' || source_path, 'import' || '|' || {_S.format('language')} || '|' || {_S.format('dependency_kind')} || '|' || {_S.format('raw_dependency')} || '|' || {_S.format('normalized_key')} || '|' || {_S.format('resolution_status')} || '|' || {_S.format('target_path')} FROM dependency_records WHERE source_path IS NOT NULL
    UNION SELECT csc_id, 'file::' || source_path, {_CHUNK_ROW} FROM knowledge_chunks WHERE source_type = 'code' AND source_path IS NOT NULL UNION SELECT csc_id, 'misc', {_CHUNK_ROW} FROM knowledge_chunks WHERE source_type <> 'code' UNION SELECT csc_id, 'sdd_section::' || section_id, {_CHUNK_ROW} FROM knowledge_chunks WHERE section_id IS NOT NULL
    UNION SELECT csc_id, source_id, 'documents' || '|' || {_S.format('target_id')} FROM graph_edges WHERE edge_type = 'documents' AND source_id LIKE 'sdd_section::%' UNION SELECT csc_id, target_id, 'changed' || '|' || {_S.format('source_id')} FROM graph_edges WHERE edge_type = 'changed_in' AND target_id LIKE 'commit::%'),
  b AS (SELECT csc_id, fragment_id, ('0x' || left(md5(row), 15))::BIGINT AS bits FROM r), g AS (SELECT csc_id, fragment_id, count(*) AS members, bit_xor(bits) AS x, sum(bits % 2147483648)::BIGINT AS t FROM b GROUP BY ALL)
  SELECT csc_id, fragment_id, members, sha256(members || '|' || x || '|' || t) AS fingerprint FROM g""")
def ref_a31_fragment_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of the structure, files, other chunks, sections and commits."""
    return G.fingerprints(*_t(spark, d, "scan", "deps", "edges", "chunks"))


@query(f"""WITH {_SYM}, n AS (SELECT DISTINCT csc_id, path, unnest(functions) AS name FROM scan_records UNION SELECT DISTINCT csc_id, path, unnest(classes) FROM scan_records),
  l AS (SELECT DISTINCT n.csc_id, n.path, n.name, s.symbol FROM n JOIN sym s ON s.csc_id = n.csc_id AND s.path = n.path AND (s.name = n.name OR s.qualified = n.name OR ends_with(s.qualified, '.' || n.name))),
  a AS (SELECT DISTINCT n.csc_id, n.path, n.name, s.symbol FROM n ANTI JOIN l USING (csc_id, path, name) JOIN sym s ON s.csc_id = n.csc_id AND lower(s.name) = lower(n.name)) SELECT *, 'local' AS found FROM l UNION ALL SELECT *, 'global' FROM a""")
def ref_j09_evidence_targets(spark: SparkSession, d: str) -> DataFrame:
    """Names told of files as symbols: of the file by name, qualified name or its end, else of any file."""
    scan, nodes = _t(spark, d, "scan", "nodes")
    refs = scan.select("csc_id", "path", F.explode(F.concat(F.coalesce("functions", F.array()), F.coalesce("classes", F.array()))).alias("name")).filter("name IS NOT NULL").distinct()
    return G.evidence_targets(refs, G.symbol_rows(nodes))


@query(f"""WITH {_BASE}, nd AS (SELECT DISTINCT csc_id, node_id FROM graph_nodes), {_SYM}, at0 AS (SELECT DISTINCT t.csc_id, t.question_id, unnest(list_filter(['chunk::' || c.chunk_id, 'file::' || c.source_path, 'sdd_section::' || c.section_id], lambda x: x IS NOT NULL)) AS node_id FROM top t JOIN chunk c USING (csc_id, chunk_id)),
  at1 AS (SELECT a.* FROM at0 a SEMI JOIN nd USING (csc_id, node_id)), e AS (SELECT DISTINCT csc_id, source_id, target_id FROM graph_edges WHERE edge_type IN ('references', 'defines', 'contains', 'documents', 'changed_in', 'impacts_section') AND source_id IS NOT NULL AND target_id IS NOT NULL),
  b AS (SELECT csc_id, source_id AS node_id, target_id AS near FROM e UNION ALL SELECT csc_id, target_id, source_id FROM e), met AS (SELECT DISTINCT a.csc_id, a.question_id, b.near AS node_id FROM at1 a JOIN b USING (csc_id, node_id) SEMI JOIN nd ON nd.csc_id = b.csc_id AND nd.node_id = b.near),
  fl AS (SELECT csc_id, question_id, substr(node_id, 7) AS path FROM (SELECT * FROM at1 UNION SELECT * FROM met) WHERE node_id LIKE 'file::%') SELECT csc_id, question_id, node_id AS symbol FROM met WHERE node_id LIKE 'sym::%' UNION SELECT f.csc_id, f.question_id, s.symbol FROM fl f JOIN sym s USING (csc_id, path)""")
def ref_j19_anchor_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that the chunks found for each question anchor, by one step over six types of edges and by file."""
    found = R.top_k(_index(spark, d), _questions(spark, d)).select("csc_id", "question_id", "chunk_id")
    chunks = R.chunk_rows(load(spark, d, "knowledge_chunks")).select("csc_id", "chunk_id", "source_path", "section_id")
    return G.anchor_symbols(found.join(chunks, ["csc_id", "chunk_id"]), *_t(spark, d, "nodes", "edges"), ["question_id"])


@query("WITH l AS (SELECT DISTINCT csc_id, source_id AS node_id, edge_type AS kind, target_id AS reference, reason AS detail FROM graph_edges WHERE target_id IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY csc_id, node_id ORDER BY kind, reference, coalesce(detail, '')) AS place FROM l")
def ref_a11_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every node, each link once, in canonical order."""
    links = load(spark, d, "graph_edges").filter("target_id IS NOT NULL").select("csc_id", F.col("source_id").alias("node_id"), F.col("edge_type").alias("kind"), F.col("target_id").alias("reference"), F.col("reason").alias("detail"))
    return G.canonical_links(links, ["csc_id", "node_id"])


_CAND = """cand AS (SELECT csc_id, target_path AS path, 0.5 AS score, 'import' AS reason, 'file::' || source_path AS related FROM dependency_records WHERE target_path IS NOT NULL UNION ALL SELECT csc_id, substr(target_id, 7), 1.0, 'documents', source_id FROM graph_edges WHERE edge_type = 'documents' AND target_id LIKE 'file::%'
    UNION ALL SELECT csc_id, substr(source_id, 7), 0.5, 'changed_in', target_id FROM graph_edges WHERE edge_type = 'changed_in' AND source_id LIKE 'file::%' AND target_id IS NOT NULL)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    deps, edges = _t(spark, d, "deps", "edges")
    row = lambda df, path, score, reason, related: df.select("csc_id", path.alias("path"), F.lit(score).alias("score"), F.lit(reason).alias("reason"), related.alias("related"))
    cut = lambda c: F.substring(c, 7, 1 << 20)
    return row(deps.filter("target_path IS NOT NULL"), F.col("target_path"), 0.5, "import", F.concat(F.lit("file::"), "source_path")).unionByName(row(edges.filter("edge_type = 'documents' AND target_id LIKE 'file::%'"), cut("target_id"), 1.0, "documents", F.col("source_id"))).unionByName(
        row(edges.filter("edge_type = 'changed_in' AND source_id LIKE 'file::%' AND target_id IS NOT NULL"), cut("source_id"), 0.5, "changed_in", F.col("target_id")))


@query(f"WITH {_CAND}, m AS (SELECT *, max(score) OVER (PARTITION BY csc_id, path) AS m FROM cand) SELECT csc_id, path, max(score)::DOUBLE AS score, min(reason) FILTER (WHERE score = m) AS reason, count(DISTINCT related) FILTER (WHERE related LIKE 'file::%') AS related_files, count(DISTINCT related) FILTER (WHERE related LIKE 'sdd_section::%') AS related_sections, count(DISTINCT related) FILTER (WHERE related LIKE 'commit::%') AS related_commits, min(related) AS first_related FROM m GROUP BY ALL")
def ref_a13_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of several sources merged: the best score, of equal ones the first reason, and what all of them relate to."""
    kinds = {"files": "file::", "sections": "sdd_section::", "commits": "commit::"}
    g = _candidates(spark, d).groupBy("csc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "reason")).alias("b"), *(F.count_distinct(F.when(F.col("related").startswith(p), F.col("related"))).alias(f"related_{k}") for k, p in kinds.items()), F.min("related").alias("first_related"))
    return g.select("csc_id", "path", (-F.col("b.s")).alias("score"), "b.reason", *(f"related_{k}" for k in kinds), "first_related")


@query(f"WITH {_CAND}, anchor AS (SELECT DISTINCT csc_id, source_id AS related FROM graph_edges WHERE edge_type = 'impacts_section' UNION SELECT DISTINCT csc_id, target_id FROM graph_edges WHERE edge_type = 'impacts_section' AND target_id IS NOT NULL) SELECT DISTINCT csc_id, path, related FROM cand ANTI JOIN anchor USING (csc_id, related) WHERE related IS NOT NULL")
def ref_a14_related(spark: SparkSession, d: str) -> DataFrame:
    """What candidates relate to, without the commits and sections that are anchors."""
    e = load(spark, d, "graph_edges").filter("edge_type = 'impacts_section'")
    anchors = e.select("csc_id", F.col("source_id").alias("related")).unionByName(e.filter("target_id IS NOT NULL").select("csc_id", F.col("target_id").alias("related"))).distinct()
    return _candidates(spark, d).filter("related IS NOT NULL").select("csc_id", "path", "related").distinct().join(anchors, ["csc_id", "related"], "left_anti").select("csc_id", "path", "related")


@query("WITH " + _BASE + "," + _FUSED + ", g AS (SELECT csc_id, question_id, chunk_id, max(graph_score) AS score FROM graph GROUP BY ALL) SELECT csc_id, question_id, chunk_id, score::DOUBLE AS score, n FROM (SELECT g.*, row_number() OVER (PARTITION BY g.csc_id, g.question_id ORDER BY score DESC, source_path, coalesce(line_start, 0), g.chunk_id) AS n FROM g JOIN chunk c USING (csc_id, chunk_id)) WHERE n <= 6")
def ref_t03_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best six graph candidates of each question by score and tie key."""
    _, graph, index, *_ = _fusion(spark, d, _questions)
    g = graph.groupBy("csc_id", "question_id", "chunk_id").agg(F.max("graph_score").alias("score")).join(index.select("csc_id", "chunk_id", "source_path", "line_start"), ["csc_id", "chunk_id"])
    w = Window.partitionBy("csc_id", "question_id").orderBy(F.desc("score"), *R.tie_key())
    return g.withColumn("n", F.row_number().over(w)).filter("n <= 6").select("csc_id", "question_id", "chunk_id", "score", "n")


@query("WITH " + _BASE + "," + _FUSED + " SELECT *, row_number() OVER (PARTITION BY csc_id, question_id ORDER BY chunk_id, source, score DESC) AS place FROM (SELECT csc_id, question_id, chunk_id, 'lexical' AS source, score::DOUBLE AS score FROM top12 UNION ALL SELECT csc_id, question_id, chunk_id, 'hierarchy', graph_score::DOUBLE FROM graph)")
def ref_u01_sources(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two sources in their total order: chunk, source, then score."""
    lexical, graph, *_ = _fusion(spark, d, _questions)
    both = lexical.select("csc_id", "question_id", "chunk_id", F.lit("lexical").alias("source"), "score").unionByName(graph.select("csc_id", "question_id", "chunk_id", F.lit("hierarchy").alias("source"), F.col("graph_score").alias("score")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("csc_id", "question_id").orderBy("chunk_id", "source", F.desc("score"))))


@query(f"""WITH {_NODES}, r AS (SELECT csc_id, directory, language, count(*) AS n FROM (SELECT csc_id, language, unnest({_UP.format('path')}) AS directory FROM file) GROUP BY ALL), a AS (SELECT csc_id, directory, sum(n)::BIGINT AS files, string_agg(language || '=' || n, ', ' ORDER BY language || '=' || n) AS languages FROM r GROUP BY ALL),
  b AS (SELECT csc_id, directory, count(*) AS directories FROM (SELECT csc_id, unnest({_UP.format('path')}) AS directory FROM dirs WHERE path <> '.') GROUP BY ALL), p AS (SELECT csc_id, directory, string_agg(path, ', ' ORDER BY path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY csc_id, directory ORDER BY path) AS n FROM (SELECT csc_id, path, unnest({_UP.format('path')}) AS directory FROM file)) WHERE n <= 3 GROUP BY ALL),
  c AS (SELECT csc_id, directory, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY csc_id, directory ORDER BY name) AS n FROM (SELECT DISTINCT csc_id, directory, unnest(classes) AS name FROM (SELECT csc_id, classes, unnest({_UP.format('path')}) AS directory FROM scan_records WHERE path IS NOT NULL))) WHERE n <= 3 GROUP BY ALL)
  SELECT csc_id, directory, 'Subtree files: ' || files || '. Subtree directories: ' || coalesce(directories, 0) || '.' || chr(10) || 'Languages: ' || languages || '.' || chr(10) || 'Key topics: ' || coalesce(names, 'none') || '.' || chr(10) || 'Representative files: ' || coalesce(paths, 'none') || '.' AS text FROM a LEFT JOIN b USING (csc_id, directory) LEFT JOIN p USING (csc_id, directory) LEFT JOIN c USING (csc_id, directory)""")
def ref_p24_rollup_text(spark: SparkSession, d: str) -> DataFrame:
    """What stands below every directory, in words."""
    scan = load(spark, d, "scan_records")
    return G.directory_texts(scan, P.structure(scan)[1], P.rollup(scan))


_CAPS = {"file": 12, "chunk": 10, "commit": 8, "symbol": 7}


@query(f"""WITH sec AS (SELECT DISTINCT csc_id, node_id AS section, section_id FROM graph_nodes WHERE node_type = 'sdd_section'), e AS (SELECT DISTINCT csc_id, edge_type, source_id, target_id FROM graph_edges WHERE target_id IS NOT NULL),
  ev AS (SELECT s.csc_id, section, CASE WHEN target_id LIKE 'file::%' THEN 'file' ELSE 'symbol' END AS family, target_id AS reference FROM sec s JOIN e ON e.csc_id = s.csc_id AND e.source_id = s.section AND e.edge_type = 'documents' UNION SELECT s.csc_id, section, 'commit', source_id FROM sec s JOIN e ON e.csc_id = s.csc_id AND e.target_id = s.section AND e.edge_type = 'impacts_section'
    UNION SELECT s.csc_id, section, 'chunk', chunk_id FROM sec s JOIN knowledge_chunks k ON k.csc_id = s.csc_id AND k.section_id = s.section_id)
  SELECT csc_id, section, family, reference, n FROM (SELECT *, row_number() OVER (PARTITION BY csc_id, section, family ORDER BY reference) AS n FROM ev) WHERE n <= CASE family {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _CAPS.items())} END""")
def ref_v11_section_packs(spark: SparkSession, d: str) -> DataFrame:
    """The evidence that a section is written from: files, symbols, commits and chunks, each family with its cap."""
    nodes, edges, chunks = _t(spark, d, "nodes", "edges", "chunks")
    sec = nodes.filter("node_type = 'sdd_section'").select("csc_id", F.col("node_id").alias("section"), "section_id").distinct()
    e = edges.filter("target_id IS NOT NULL").select("csc_id", "edge_type", "source_id", "target_id").distinct()
    documents = sec.join(e.filter("edge_type = 'documents'").withColumnRenamed("source_id", "section"), ["csc_id", "section"]).select("csc_id", "section", F.when(F.col("target_id").startswith("file::"), "file").otherwise("symbol").alias("family"), F.col("target_id").alias("reference"))
    commits = sec.join(e.filter("edge_type = 'impacts_section'").select("csc_id", F.col("target_id").alias("section"), F.col("source_id").alias("reference")), ["csc_id", "section"]).select("csc_id", "section", F.lit("commit").alias("family"), "reference")
    own = sec.join(chunks.select("csc_id", "section_id", "chunk_id"), ["csc_id", "section_id"]).select("csc_id", "section", F.lit("chunk").alias("family"), F.col("chunk_id").alias("reference"))
    w = Window.partitionBy("csc_id", "section", "family").orderBy("reference")
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in _CAPS.items() for x in kv)), F.col("family"))
    return documents.unionByName(commits).unionByName(own).distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)
