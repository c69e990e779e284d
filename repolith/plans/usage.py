"""Queries on the use of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolith.operators import usage as U
from repolith.plans.repository import _SUB
from repolith.session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_USED = f"""e AS (SELECT csc_id, language AS ecosystem, normalized_key AS package, CASE WHEN language IN ('python', 'rust') THEN replace(lower(normalized_key), '_', '-') WHEN language IS NULL THEN normalized_key ELSE lower(normalized_key) END AS name,
    CASE WHEN bool_and(coalesce(regexp_matches(source_path, '(^|/)[^/]*test[^/]*$'), false)) THEN 'test' ELSE 'runtime' END AS role FROM dependency_records WHERE lower(trim(resolution_status)) = 'unresolved' AND normalized_key IS NOT NULL GROUP BY csc_id, language, normalized_key),
  t0 AS (SELECT DISTINCT csc_id, path, unnest(regexp_extract_all(raw, '[@A-Za-z0-9_./:-]+')) AS token FROM (SELECT csc_id, path, unnest(imports) AS raw FROM scan_records)),
  t1 AS (SELECT * FROM t0 UNION SELECT csc_id, path, split_part(token, '::', 1) FROM t0 WHERE contains(token, '::') UNION SELECT csc_id, path, split_part(token, '/', 1) FROM t0 WHERE contains(token, '/') AND NOT starts_with(token, '@') UNION SELECT csc_id, path, split_part(token, '.', 1) FROM t0 WHERE contains(token, '.')),
  tok AS (SELECT csc_id, path, {_SUB} AS subsystem_id, lower(token) AS token FROM t1 WHERE token NOT IN ('', 'from', 'import', 'use', 'as')),
  link AS (SELECT e.csc_id, e.ecosystem, e.package, tok.path, tok.subsystem_id FROM e JOIN tok ON tok.csc_id = e.csc_id AND e.ecosystem IN ('python', 'rust') AND replace(tok.token, '_', '-') = e.name
    UNION SELECT e.csc_id, e.ecosystem, e.package, tok.path, tok.subsystem_id FROM e JOIN tok ON tok.csc_id = e.csc_id AND e.ecosystem IN ('javascript', 'typescript') AND tok.token = e.name
    UNION SELECT e.csc_id, e.ecosystem, e.package, tok.path, tok.subsystem_id FROM e JOIN tok ON tok.csc_id = e.csc_id AND e.ecosystem = 'go' AND (tok.token = e.name OR starts_with(tok.token, e.name || '/') OR starts_with(e.name, tok.token || '/'))),
  cnt AS (SELECT csc_id, ecosystem, package, count(DISTINCT path) AS modules, count(DISTINCT subsystem_id) AS subsystems, min(path) AS first_module FROM link GROUP BY ALL),
  used AS (SELECT e.csc_id, e.ecosystem, e.package, e.name, e.role, coalesce(modules, 0) AS modules, coalesce(subsystems, 0) AS subsystems, first_module FROM e LEFT JOIN cnt ON cnt.csc_id = e.csc_id AND cnt.ecosystem = e.ecosystem AND cnt.package = e.package)"""


def _used(spark: SparkSession, d: str) -> DataFrame:
    return U.usage(load(spark, d, "scan_records"), load(spark, d, "dependency_records"))


@query(f"WITH {_USED} SELECT * FROM used")
def ref_j17_dependency_usage(spark: SparkSession, d: str) -> DataFrame:
    """Modules whose imports name an external package of their repository."""
    return _used(spark, d)


@query(f"WITH {_USED} SELECT csc_id, ecosystem, package, role, coalesce(ecosystem IN {U.RELIABLE}, false) AS reliable, role IN {U.GROUPABLE} AS groupable, modules > 0 AS strong FROM used")
def ref_f08_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether each package's imports count, its role may be told of in a group, and its use is known."""
    return U.gates(_used(spark, d)).select("csc_id", "ecosystem", "package", "role", "reliable", "groupable", "strong")


_GENERAL = "CASE " + " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in U.KNOWN.items()) + " " + " ".join(f"WHEN contains(name, '{k}') THEN '{v}'" for k, v in U.KNOWN_WORDS.items()) + " WHEN ecosystem = 'python' THEN package || ' is a Python package used in this ecosystem.' WHEN ecosystem IN ('javascript', 'typescript') THEN package || ' is a ' || ecosystem || ' package used in this ecosystem.' ELSE package || ' is a direct dependency declared for this project.' END"
_TITLE = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.GROUP_TITLES.items()) + " END"


@query(f"""WITH {_USED}, x AS (SELECT *, CASE WHEN role IN ('runtime', 'peer', 'optional') THEN 'dependencies' ELSE 'build_development_infrastructure' END AS section_target FROM used), y AS (SELECT *, section_target = 'build_development_infrastructure' AND modules = 0 AND role IN {U.GROUPABLE} AS grouped FROM x)
  SELECT csc_id, ecosystem, package, section_target, CASE WHEN grouped THEN 'grouped_tooling' ELSE 'standard' END AS render_style, CASE WHEN grouped THEN 'Project ' || CASE WHEN ecosystem IS NOT NULL AND ecosystem NOT IN ('unknown', '') THEN upper(ecosystem[1]) || lower(ecosystem[2:]) || ' ' ELSE '' END || {_TITLE} END AS group_title, {_GENERAL} AS general,
    CASE WHEN modules > 0 THEN 'Observed usage signals include `' || first_module || ' imports ' || package || '`; linked modules: ' || modules || '; linked subsystems: ' || subsystems || '.' ELSE '{U.NO_USE}' END AS usage, CASE WHEN modules > 0 THEN 'project_evidence' ELSE 'tbd' END AS basis FROM y""")
def ref_v13_narratives(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each package and of its use, tooling without evidence being told of in groups."""
    return U.narratives(_used(spark, d))
