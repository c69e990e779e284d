"""Queries on rubric scores, comparisons and the gate.

There is no judge in the data: events stand for a judge's answers, each being one answer on one dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators import benchmark as B
from repolith.operators.repository import subsystem
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


_NAMES = list(B.VARIANTS)
_PICK = lambda items, i: "CASE " + i + " " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(items)) + " END"
_RAW = f"""raw_ AS (SELECT 'case-' || (user_id % 5) AS case_id, {_PICK(_NAMES, '(event_id % 5)')} AS variant_id, {_PICK(B.DIMENSIONS, '((event_id // 5) % 7)')} AS dimension, event_id AS at_, floor(value)::BIGINT % 8 AS x, value,
    CASE event_id % 4 WHEN 0 THEN (floor(value)::BIGINT % 8)::VARCHAR WHEN 1 THEN (floor(value)::BIGINT % 8)::VARCHAR || '/5' WHEN 2 THEN CASE WHEN floor(value)::BIGINT % 2 = 0 THEN 'true' ELSE 'n/a' END ELSE '-' || (floor(value)::BIGINT % 8) END AS raw FROM (SELECT DISTINCT event_id, user_id, value FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL))"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").filter("event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL").select("event_id", "user_id", "value").distinct()
    at, x = F.col("event_id"), (F.floor("value") % 8).cast("string")
    pick = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i + 1).cast("int"))
    raw = F.when(at % 4 == 0, x).when(at % 4 == 1, F.concat(x, F.lit("/5"))).when(at % 4 == 2, F.when(F.floor("value") % 2 == 0, "true").otherwise("n/a")).otherwise(F.concat(F.lit("-"), x))
    return e.select(F.concat(F.lit("case-"), (F.col("user_id") % 5).cast("string")).alias("case_id"), pick(_NAMES, at % 5).alias("variant_id"), pick(B.DIMENSIONS, F.floor(at / 5) % 7).alias("dimension"), at.alias("at"), "value", raw.alias("raw"))


def _facts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("case_id", "variant_id").agg(F.count_if(F.col("value") > 95).alias("risks"), F.max(F.col("value") < 0.01).alias("tbd"), F.lit(False).alias("failed"), F.count_if(F.col("value") < 0.002).alias("errors"))


_SCORE = "coalesce(CASE WHEN raw = 'true' THEN 1 WHEN raw = 'false' THEN 0 WHEN regexp_matches(raw, '^-?[0-9]+$') THEN greatest(0, least(5, raw::INT)) WHEN regexp_matches(raw, '^[0-9]') THEN least(5, left(raw, 1)::INT) END, 0)"
_RUBRIC = _RAW + f""", last_ AS (SELECT case_id, variant_id, dimension, arg_max(raw, at_) AS raw FROM raw_ GROUP BY ALL), cv AS (SELECT DISTINCT case_id, variant_id FROM raw_), dims AS (SELECT unnest({list(B.DIMENSIONS)}) AS dimension),
  rub AS (SELECT cv.case_id, cv.variant_id, dims.dimension, {_SCORE} AS score FROM cv CROSS JOIN dims LEFT JOIN last_ USING (case_id, variant_id, dimension)),
  fact AS (SELECT case_id, variant_id, count(*) FILTER (WHERE value > 95) AS risks, bool_or(value < 0.01) AS tbd, count(*) FILTER (WHERE value < 0.002) AS errors FROM raw_ GROUP BY ALL),
  rep AS (SELECT r.case_id, r.variant_id, overall, risks, tbd, false AS failed, errors FROM (SELECT case_id, variant_id, round(avg(score), 3) AS overall FROM rub GROUP BY ALL) r JOIN fact USING (case_id, variant_id))"""


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    answers = _answers(spark, d)
    scores = B.rubric(answers)
    return scores, B.reports(scores, _facts(answers))


@query(f"WITH {_RUBRIC} SELECT * FROM rub")
def ref_v22_rubric(spark: SparkSession, d: str) -> DataFrame:
    """Scores of seven dimensions from whatever was answered, missing ones with 0."""
    return _scores(spark, d)[0]


@query(f"WITH {_RUBRIC} SELECT * FROM rep")
def ref_a32_reports(spark: SparkSession, d: str) -> DataFrame:
    """One quality report for each case and variant."""
    return _scores(spark, d)[1]


@query(f"WITH {_RUBRIC} SELECT variant_id, count(*) AS cases, round(avg(overall), 3) AS average, sum(risks)::BIGINT AS risks, count(*) FILTER (WHERE failed) AS failures, sum(errors)::BIGINT AS errors FROM rep GROUP BY ALL")
def ref_a24_variant_averages(spark: SparkSession, d: str) -> DataFrame:
    return B.variant_summary(_scores(spark, d)[1])


_PAIRS = _RUBRIC + f""", pl AS (SELECT *, list_position({_NAMES}, variant_id) AS place FROM rep), pair AS (SELECT a.case_id, a.variant_id AS baseline, b.variant_id AS candidate, round(b.overall - a.overall, 3) AS delta,
    CASE WHEN b.overall > a.overall THEN b.variant_id WHEN b.overall < a.overall THEN a.variant_id WHEN b.risks < a.risks THEN b.variant_id WHEN b.risks > a.risks THEN a.variant_id WHEN NOT b.tbd AND a.tbd THEN b.variant_id WHEN b.tbd AND NOT a.tbd THEN a.variant_id END AS better
    FROM pl a JOIN pl b ON a.case_id = b.case_id AND a.place < b.place), cmp AS (SELECT case_id, baseline, candidate, delta, coalesce(better, least(baseline, candidate)) AS preferred, better IS NULL AS tie FROM pair)"""


@query(f"WITH {_PAIRS} SELECT * FROM cmp")
def ref_a25_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of variants of a case: score, risks, work left, then name."""
    return B.comparisons(_scores(spark, d)[1])


@query(f"""WITH {_PAIRS}, s AS (SELECT variant_id, round(avg(overall), 3) AS average, sum(risks) AS risks, count(*) FILTER (WHERE failed) AS failures, sum(errors) AS errors FROM rep GROUP BY ALL),
  dm AS (SELECT variant_id, {', '.join(f"round(avg(score) FILTER (WHERE dimension = '{k}'), 3) AS {k}" for k in B.KEPT_DIMENSIONS)} FROM rub GROUP BY ALL), f AS (SELECT s.*, {', '.join(B.KEPT_DIMENSIONS)} FROM s JOIN dm USING (variant_id)),
  rv AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in B.RIVALS.items())}) AS v(variant_id, rival)), won AS (SELECT candidate, baseline, count(*) FILTER (WHERE preferred = candidate) AS wins FROM cmp GROUP BY ALL),
  g AS (SELECT m.*, rv.rival, round(m.average - r.average, 3) AS delta, coalesce(w.wins, 0) AS wins, coalesce(wb.wins, 0) AS b_wins, r.risks AS r_risks, r.failures AS r_failures, {', '.join(f'r.{k} AS r_{k}' for k in B.KEPT_DIMENSIONS)}, (SELECT average FROM f WHERE variant_id = 'baseline') AS b_average
    FROM f m JOIN rv USING (variant_id) JOIN f r ON r.variant_id = rv.rival LEFT JOIN won w ON w.candidate = m.variant_id AND w.baseline = rv.rival LEFT JOIN won wb ON wb.candidate = m.variant_id AND wb.baseline = 'baseline'),
  h AS (SELECT variant_id, rival, delta, wins, list_filter([CASE WHEN delta < 0.25 THEN 'score' END, CASE WHEN wins < 3 THEN 'wins' END, CASE WHEN variant_id <> 'semantic-structure-context' AND failures > r_failures THEN 'failures' END, CASE WHEN variant_id <> 'semantic-structure-context' AND risks > r_risks THEN 'risks' END,
    CASE WHEN variant_id = 'semantic-structure-context' AND average <= b_average THEN 'baseline' END, CASE WHEN variant_id = 'semantic-structure-context' AND b_wins < 3 THEN 'baseline_wins' END, CASE WHEN variant_id <> 'semantic-clustering' AND errors > 0 THEN 'validation' END,
    {', '.join(f"CASE WHEN variant_id = 'semantic-structure-context' AND {k} < r_{k} THEN 'dimension:{k}' END" for k in B.KEPT_DIMENSIONS)}], lambda x: x IS NOT NULL) AS reasons FROM g)
  SELECT *, len(reasons) = 0 AS passes FROM h""")
def ref_v23_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each variant may be promoted over its rival, and why not."""
    return B.promotion_gate(*_scores(spark, d))


_TAGS = f"""m AS (SELECT csc_id, count(DISTINCT path) AS modules, count(DISTINCT {_SUB}) AS subsystems, count(DISTINCT path) FILTER (WHERE len(coalesce(functions, [])) >= 5) AS dense FROM scan_records WHERE path IS NOT NULL GROUP BY ALL), r AS (SELECT csc_id, count(DISTINCT normalized_key) AS deps FROM dependency_records GROUP BY ALL),
  t AS (SELECT csc_id, unnest(list_filter(['small', CASE WHEN modules >= 20 THEN 'medium' END, CASE WHEN dense >= 3 THEN 'algorithm-heavy' END, CASE WHEN coalesce(deps, 0) >= 20 THEN 'dependency-heavy' END, CASE WHEN subsystems >= 5 THEN 'architecture-heavy' END], lambda x: x IS NOT NULL AND (x <> 'small' OR modules < 20))) AS tag FROM m LEFT JOIN r USING (csc_id))"""


@query(f"WITH {_TAGS} SELECT w.tag, count(DISTINCT csc_id) AS cases, count(csc_id) > 0 AS covered FROM (SELECT unnest({list(B.FOCUS_TAGS)}) AS tag) w LEFT JOIN t ON t.tag = w.tag GROUP BY w.tag")
def ref_v24_focus_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Required tags, and how many repositories would serve as cases for each by their size and make."""
    s = load(spark, d, "scan_records").filter("path IS NOT NULL")
    m = s.groupBy("csc_id").agg(F.count_distinct("path").alias("modules"), F.count_distinct(subsystem(F.col("path"))).alias("subsystems"), F.count_distinct(F.when(F.size("functions") >= 5, F.col("path"))).alias("dense"))
    r = load(spark, d, "dependency_records").groupBy("csc_id").agg(F.count_distinct("normalized_key").alias("deps"))
    a = m.join(r, "csc_id", "left").fillna(0, ["deps"])
    tags = F.array_compact(F.array(F.when(F.col("modules") < 20, "small"), F.when(F.col("modules") >= 20, "medium"), F.when(F.col("dense") >= 3, "algorithm-heavy"), F.when(F.col("deps") >= 20, "dependency-heavy"), F.when(F.col("subsystems") >= 5, "architecture-heavy")))
    return B.focus_coverage(a.select(F.col("csc_id").alias("case_id"), F.explode(tags).alias("tag")))


@query(f"SELECT csc_id AS case_id, v.* FROM (SELECT DISTINCT csc_id FROM scan_records) CROSS JOIN (VALUES {', '.join(f'''('{k}', '{a}', '{b}', '{c}')''' for k, (a, b, c) in B.VARIANTS.items())}) AS v(variant_id, grouping_mode, section_mode, render_mode)".replace("'''", ""))
def ref_d13_variants(spark: SparkSession, d: str) -> DataFrame:
    """The settings under which each case is built, a row for each variant."""
    rows = F.array(*(F.struct(F.lit(k).alias("variant_id"), F.lit(a).alias("grouping_mode"), F.lit(b).alias("section_mode"), F.lit(c).alias("render_mode")) for k, (a, b, c) in B.VARIANTS.items()))
    return load(spark, d, "scan_records").select(F.col("csc_id").alias("case_id")).distinct().select("case_id", F.explode(rows).alias("v")).select("case_id", "v.*")
