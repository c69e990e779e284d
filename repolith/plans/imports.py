"""Queries over imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.text import tokens
from repolith.operators import imports as I
from repolith.plans.repository import _LANGUAGE
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FIRST = lambda p: f"nullif(regexp_extract(raw, '{p}', 1), '')"
_Q = "[''\"]([^''\"]+)[''\"]"
_RUST = "nullif(regexp_replace(trim(split_part(trim(split_part(regexp_extract(raw, '^(?:pub\\s+)?use\\s+(.+);', 1), ' as ', 1)), '{', 1)), ':+$', ''), '')"
_KEYS = f"""file AS (SELECT DISTINCT csc_id, path FROM scan_records WHERE path IS NOT NULL),
imp AS (SELECT DISTINCT csc_id, path, {_LANGUAGE} AS language, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS raw FROM (SELECT csc_id, path, unnest(imports) AS raw FROM scan_records)),
k AS (
  SELECT csc_id, path, language, raw, 'import' AS kind, trim(split_part(trim(unnest(string_split(substr(raw, 8), ','))), ' as ', 1)) AS key FROM imp WHERE language = 'python' AND raw LIKE 'import %'
  UNION SELECT csc_id, path, language, raw, 'import', {_FIRST('^from\\s+([A-Za-z0-9_.]+)\\s+import\\s+')} FROM imp WHERE language = 'python' AND raw NOT LIKE 'import %'
  UNION SELECT csc_id, path, language, raw, 'import', {_FIRST('import\\s+.+?\\s+from\\s+' + _Q)} FROM imp WHERE language IN ('javascript', 'typescript')
  UNION SELECT csc_id, path, language, raw, 'import', {_FIRST('import\\s+' + _Q)} FROM imp WHERE language IN ('javascript', 'typescript')
  UNION SELECT csc_id, path, language, raw, 'import', {_FIRST('export\\s+.+?\\s+from\\s+' + _Q)} FROM imp WHERE language IN ('javascript', 'typescript')
  UNION SELECT csc_id, path, language, raw, 'require', {_FIRST('require\\(\\s*' + _Q + '\\s*\\)')} FROM imp WHERE language IN ('javascript', 'typescript')
  UNION SELECT csc_id, path, language, raw, 'import', {_FIRST('^import\\s+(?:static\\s+)?([A-Za-z0-9_.*]+)\\s*;')} FROM imp WHERE language = 'java'
  UNION SELECT csc_id, path, language, raw, 'import', {_FIRST(_Q)} FROM imp WHERE language = 'go'
  UNION SELECT csc_id, path, language, raw, 'use', {_RUST} FROM imp WHERE language = 'rust'
  UNION SELECT csc_id, path, language, raw, 'using', {_FIRST('^(?:global\\s+)?using\\s+([A-Za-z0-9_.]+)\\s*;')} FROM imp WHERE language = 'csharp'
  UNION SELECT csc_id, path, language, raw, 'include', {_FIRST('^#\\s*include\\s*[<"]([^>"]+)[>"]')} FROM imp WHERE language = 'cpp'),
key AS (SELECT * FROM k WHERE key IS NOT NULL AND key <> '')"""
_WITH = f"WITH {_KEYS}, "


def _one(rows: str) -> str:
    return f"(SELECT csc_id, key, min(target) AS target FROM ({rows}) GROUP BY csc_id, key HAVING count(DISTINCT target) = 1)"


_PY = _one("SELECT csc_id, path AS target, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) AS key FROM (SELECT csc_id, path, string_split(regexp_replace(regexp_replace(path, '\\.py$', ''), '/?__init__$', ''), '/') AS p FROM file WHERE path LIKE '%.py') WHERE array_to_string(p, '') <> ''")
_CS = _one("SELECT csc_id, path AS target, unnest(regexp_extract_all(text, '(?m)^\\s*namespace\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS key FROM scan_records WHERE path LIKE '%.cs' AND text IS NOT NULL")
_JAVA = _one("SELECT csc_id, target, CASE WHEN p = '' THEN name ELSE p || '.' || name END AS key FROM (SELECT csc_id, path AS target, regexp_extract(coalesce(text, ''), '(?m)^\\s*package\\s+([A-Za-z0-9_.]+)\\s*;', 1) AS p, unnest(classes) AS name FROM scan_records WHERE path LIKE '%.java')")


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "scan_records")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select("csc_id", "path").filter("path IS NOT NULL").distinct()


@query(_WITH[:-2] + " SELECT csc_id, path, raw, key FROM key WHERE language = 'python'")
def ref_p10_python_modules(spark: SparkSession, d: str) -> DataFrame:
    return I.import_keys(_scan(spark, d)).filter("language = 'python'").select("csc_id", "path", "raw", "key")


@query(_WITH[:-2] + " SELECT csc_id, path, raw, kind, key FROM key WHERE language IN ('javascript', 'typescript')")
def ref_p11_js_modules(spark: SparkSession, d: str) -> DataFrame:
    return I.import_keys(_scan(spark, d)).filter("language IN ('javascript', 'typescript')").select("csc_id", "path", "raw", "kind", "key")


@query(_WITH[:-2] + " SELECT csc_id, path, language, raw, kind, key FROM key WHERE language IN ('go', 'rust', 'cpp', 'java', 'csharp')")
def ref_p12_other_modules(spark: SparkSession, d: str) -> DataFrame:
    return I.import_keys(_scan(spark, d)).filter("language IN ('go', 'rust', 'cpp', 'java', 'csharp')").select("csc_id", "path", "language", "raw", "kind", "key")


@query("""WITH t AS (SELECT DISTINCT csc_id, path, unnest(regexp_extract_all(raw, '[@A-Za-z0-9_./:-]+')) AS token FROM (SELECT csc_id, path, unnest(imports) AS raw FROM scan_records)),
  u AS (SELECT * FROM t UNION SELECT csc_id, path, split_part(token, '::', 1) FROM t WHERE contains(token, '::') UNION SELECT csc_id, path, split_part(token, '/', 1) FROM t WHERE contains(token, '/') AND NOT starts_with(token, '@') UNION SELECT csc_id, path, split_part(token, '.', 1) FROM t WHERE contains(token, '.'))
  SELECT * FROM u WHERE token NOT IN ('', 'from', 'import', 'use', 'as')""")
def ref_p13_import_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Names that an import may mean: its words, and what stands before the first `::`, `/` or `.` of each."""
    words = _scan(spark, d).select("csc_id", "path", F.explode("imports").alias("raw")).select("csc_id", "path", F.explode(F.regexp_extract_all("raw", F.lit("[@A-Za-z0-9_./:-]+"), F.lit(0))).alias("t"))
    head = lambda mark, ok: F.when(F.col("t").contains(mark) & ok, F.split_part("t", F.lit(mark), F.lit(1)))
    every = F.array_compact(F.array("t", head("::", F.lit(True)), head("/", ~F.col("t").startswith("@")), head(".", F.lit(True))))
    return words.select("csc_id", "path", F.explode(every).alias("token")).filter(~F.col("token").isin("", "from", "import", "use", "as")).distinct()


@query("SELECT DISTINCT csc_id, dependency_id, CASE WHEN language IN ('python', 'rust') THEN replace(lower(normalized_key), '_', '-') WHEN language IS NULL THEN normalized_key ELSE lower(normalized_key) END AS name FROM dependency_records WHERE normalized_key IS NOT NULL")
def ref_p14_package_names(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "dependency_records").filter("normalized_key IS NOT NULL")
    name = F.when(F.col("language").isin("python", "rust"), F.translate(F.lower("normalized_key"), "_", "-")).when(F.col("language").isNull(), F.col("normalized_key")).otherwise(F.lower("normalized_key"))
    return r.select("csc_id", "dependency_id", name.alias("name")).distinct()


@query(_WITH + f"m AS {_PY} SELECT * FROM m")
def ref_j03_python_index(spark: SparkSession, d: str) -> DataFrame:
    return I.python_modules(_files(spark, d))


@query(_WITH + f"m AS {_CS} SELECT * FROM m")
def ref_j03_csharp_index(spark: SparkSession, d: str) -> DataFrame:
    return I.namespace_files(_scan(spark, d))


@query(_WITH + f"m AS {_JAVA} SELECT * FROM m")
def ref_j03_java_index(spark: SparkSession, d: str) -> DataFrame:
    return I.java_types(_scan(spark, d))


_INDEX = """own AS (SELECT csc_id, path, regexp_replace(path, '\\.[^./]*$', '') AS stem, CASE WHEN path LIKE '%.go' THEN 'go' ELSE 'js' END AS family FROM file WHERE regexp_matches(path, '\\.(js|mjs|cjs|ts|tsx|go)$')),
idx AS (SELECT csc_id, family, path AS target, stem AS ik FROM own UNION SELECT csc_id, family, path, regexp_extract(stem, '([^/]+)$', 1) FROM own
  UNION SELECT csc_id, family, path, regexp_replace(path, '/[^/]*$', '') FROM own WHERE regexp_extract(stem, '([^/]+)$', 1) = 'index' AND contains(path, '/')),
want AS (SELECT DISTINCT csc_id, language, CASE language WHEN 'go' THEN 'go' ELSE 'js' END AS family, key FROM key WHERE language IN ('javascript', 'typescript', 'go') AND NOT starts_with(key, '.') AND NOT starts_with(key, '/')),
direct AS (SELECT w.csc_id, w.language, w.key, min(target) AS target FROM want w JOIN idx i ON i.csc_id = w.csc_id AND i.family = w.family AND i.ik = w.key GROUP BY ALL HAVING count(DISTINCT target) = 1),
ends AS (SELECT w.csc_id, w.language, w.key, min(target) AS target FROM (SELECT * FROM want ANTI JOIN direct USING (csc_id, language, key)) w JOIN idx i ON i.csc_id = w.csc_id AND i.family = w.family AND ends_with(i.ik, w.key) GROUP BY ALL HAVING count(DISTINCT target) = 1),
suf AS (SELECT * FROM direct UNION ALL SELECT * FROM ends)"""


@query(_WITH + _INDEX + " SELECT * FROM suf")
def ref_j04_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    keys = I.import_keys(_scan(spark, d)).filter("language IN ('javascript', 'typescript', 'go') AND NOT startswith(key, '.') AND NOT startswith(key, '/')")
    return I.suffix_targets(keys, _files(spark, d))


@query(_WITH[:-2] + " SELECT csc_id, language, kind, count(*) AS imports, count(DISTINCT key) AS keys FROM key GROUP BY ALL")
def ref_j08_import_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.import_keys(_scan(spark, d)).groupBy("csc_id", "language", "kind").agg(F.count("*").alias("imports"), F.count_distinct("key").alias("keys"))


@query()
def ref_j05_relative(spark: SparkSession, d: str) -> DataFrame:
    """Relative imports of JavaScript, TypeScript and Go to files."""
    keys = I.import_keys(_scan(spark, d)).filter("language IN ('javascript', 'typescript', 'go') AND (startswith(key, '.') OR startswith(key, '/'))")
    return I.relative_targets(keys, _files(spark, d))


@query(_WITH + f"py AS {_PY}, ja AS {_JAVA}, cs AS {_CS} SELECT key.csc_id, key.path, key.language, key.key, coalesce(py.target, ja.target, cs.target) AS target FROM key LEFT JOIN py ON key.language = 'python' AND py.csc_id = key.csc_id AND py.key = key.key LEFT JOIN ja ON key.language = 'java' AND ja.csc_id = key.csc_id AND ja.key = key.key LEFT JOIN cs ON key.language = 'csharp' AND cs.csc_id = key.csc_id AND cs.key = key.key WHERE language IN ('python', 'java', 'csharp') GROUP BY ALL")
def ref_j08_unique_key(spark: SparkSession, d: str) -> DataFrame:
    """Imports that resolve through an index of unique keys."""
    return I.resolved(_scan(spark, d)).filter("language IN ('python', 'java', 'csharp')").select("csc_id", "path", "language", "key", "target").distinct()


@query()
def ref_j08_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every import of every language with its status and target."""
    return I.resolved(_scan(spark, d))


@query("""WITH r AS (SELECT DISTINCT csc_id, dependency_id, source_path, language, normalized_key, lower(trim(resolution_status)) AS status FROM dependency_records WHERE normalized_key IS NOT NULL)
  SELECT csc_id, language, normalized_key, count(*) AS uses, count(DISTINCT source_path) AS modules, bool_or(status <> 'unresolved') AS internal FROM r GROUP BY ALL""")
def ref_a12_dependency_inventory(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "dependency_records").filter("normalized_key IS NOT NULL").select("csc_id", "dependency_id", "source_path", "language", "normalized_key", F.lower(F.trim("resolution_status")).alias("status")).distinct()
    return r.groupBy("csc_id", "language", "normalized_key").agg(F.count("*").alias("uses"), F.count_distinct("source_path").alias("modules"), F.bool_or(F.col("status") != "unresolved").alias("internal"))


@query("""SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(dependency_kind) = 0 THEN 'kind' ELSE 'status' END AS facet, coalesce(language, dependency_kind, status) AS value, count(*) AS records, count(DISTINCT csc_id) AS repositories
  FROM (SELECT DISTINCT csc_id, dependency_id, coalesce(language, '-') AS language, coalesce(dependency_kind, '-') AS dependency_kind, coalesce(lower(trim(resolution_status)), '-') AS status FROM dependency_records) GROUP BY GROUPING SETS ((language), (dependency_kind), (status))""")
def ref_a27_landscape(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies by language, by kind and by status in one pass."""
    r = load(spark, d, "dependency_records").select("csc_id", "dependency_id", F.coalesce("language", F.lit("-")).alias("language"), F.coalesce("dependency_kind", F.lit("-")).alias("kind"), F.coalesce(F.lower(F.trim("resolution_status")), F.lit("-")).alias("status")).distinct()
    facets = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("language", "kind", "status"))))
    return r.select("csc_id", facets.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("records"), F.count_distinct("csc_id").alias("repositories"))


