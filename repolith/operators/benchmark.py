"""Rubric scores of documents, comparisons of variants, and the gate that promotes one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimensions of the rubric, tags that a suite of cases must cover, variants in order with their settings, and thresholds of the gate.
DIMENSIONS = ("coverage", "coherence", "specificity", "algorithm_understanding", "dependency_understanding", "rationale_capture", "present_state_tone")
FOCUS_TAGS = ("small", "medium", "algorithm-heavy", "dependency-heavy", "architecture-heavy")
VARIANTS = {  # grouping, sections, narrative
    "baseline": ("path", "default", "baseline"), "semantic-clustering": ("semantic", "default", "baseline"), "semantic-structure-context": ("semantic", "semantic_context", "targeted_llm_rewrite"),
    "semantic-structure-context-llm-draft": ("semantic", "semantic_context", "llm_draft"), "semantic-structure-context-llm-repair": ("semantic", "semantic_context", "llm_repair"),
}
DELTA, WINS, KEPT_DIMENSIONS = 0.25, 3, ("coverage", "coherence", "present_state_tone")
#: Of each candidate the variant it must beat.
RIVALS = {"semantic-clustering": "baseline", "semantic-structure-context": "semantic-clustering", "semantic-structure-context-llm-draft": "semantic-structure-context", "semantic-structure-context-llm-repair": "semantic-structure-context"}


def judge_score(raw: Column) -> Column:
    """0 to 5 from whatever a judge wrote: a boolean, a number, or a text's leading digit; null if none."""
    t = F.trim(raw)
    whole = F.when(t.rlike(r"^-?\d{1,9}(\.\d+)?$"), t.cast("double"))
    return F.when(F.lower(t) == "true", 1).when(F.lower(t) == "false", 0).when(whole.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), F.bround(whole).cast("int")))).when(t.rlike("^[0-9]"), F.least(F.lit(5), F.substring(t, 1, 1).cast("int")))


def rubric(answers: DataFrame) -> DataFrame:
    """(case_id, variant_id, dimension, score) from answers (case_id, variant_id, dimension, raw, at), the last by (at, raw) of a dimension; a missing or unreadable dimension has 0."""
    last = answers.groupBy("case_id", "variant_id", "dimension").agg(F.max_by("raw", F.struct("at", "raw")).alias("raw"))
    every = answers.select("case_id", "variant_id").distinct().select("case_id", "variant_id", F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension"))
    return every.join(last, ["case_id", "variant_id", "dimension"], "left").select("case_id", "variant_id", "dimension", F.coalesce(judge_score(F.col("raw")), F.lit(0)).alias("score"))


def reports(scores: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, variant_id, overall, risks, tbd, failed, errors) from rubric scores and facts (case_id, variant_id, risks, tbd, failed, errors); a failed evaluation has 0.0."""
    mean = scores.groupBy("case_id", "variant_id").agg(F.round(F.avg("score"), 3).alias("mean"))
    return mean.join(facts, ["case_id", "variant_id"]).select("case_id", "variant_id", F.when(F.col("failed"), 0.0).otherwise(F.col("mean")).alias("overall"), "risks", "tbd", "failed", "errors")


def variant_summary(reports_: DataFrame) -> DataFrame:
    """(variant_id, cases, average, risks, failures, errors)."""
    return reports_.groupBy("variant_id").agg(F.count("*").alias("cases"), F.round(F.avg("overall"), 3).alias("average"), F.sum("risks").alias("risks"), F.count_if("failed").alias("failures"), F.sum("errors").alias("errors"))


def comparisons(reports_: DataFrame) -> DataFrame:
    """(case_id, baseline, candidate, delta, preferred, tie): each pair of variants of a case in the order of VARIANTS.

    The better score is preferred, then fewer risks, then not leaving too much to be done, then the smaller name. A case has few variants.
    """
    place = F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant_id"))
    r = reports_.withColumn("place", place)
    pick = ["case_id", "variant_id", "overall", "risks", "tbd", "place"]
    a, b = (r.select(F.col("case_id"), *(F.col(c).alias(f"{p}_{c}") for c in pick[1:])) for p in ("a", "b"))
    j = a.join(b, "case_id").filter("a_place < b_place")
    one, other = F.col("a_variant_id"), F.col("b_variant_id")
    better = F.when(F.col("b_overall") > F.col("a_overall"), other).when(F.col("b_overall") < F.col("a_overall"), one).when(F.col("b_risks") < F.col("a_risks"), other).when(F.col("b_risks") > F.col("a_risks"), one).when(
        ~F.col("b_tbd") & F.col("a_tbd"), other).when(F.col("b_tbd") & ~F.col("a_tbd"), one)
    return j.select("case_id", one.alias("baseline"), other.alias("candidate"), F.round(F.col("b_overall") - F.col("a_overall"), 3).alias("delta"), F.coalesce(better, F.least(one, other)).alias("preferred"), better.isNull().alias("tie"))


def promotion_gate(scores: DataFrame, reports_: DataFrame) -> DataFrame:
    """(variant_id, rival, delta, wins, reasons, passes): whether each candidate may be promoted over its rival.

    reasons: `score` below the least gain, `wins` too few; more `failures` or `risks`
    than the rival, except for the context variant, which instead must beat the baseline's average (`baseline`)
    and win against it (`baseline_wins`) and keep three dimensions (`dimension:…`);
    any validation error (`validation`), except for clustering. A handful of rows a variant.
    """
    s, c = variant_summary(reports_), comparisons(reports_)
    dims = scores.filter(F.col("dimension").isin(*KEPT_DIMENSIONS)).groupBy("variant_id", "dimension").agg(F.round(F.avg("score"), 3).alias("mean"))
    wide = dims.groupBy("variant_id").agg(*(F.max(F.when(F.col("dimension") == d, F.col("mean"))).alias(d) for d in KEPT_DIMENSIONS))
    full = s.join(wide, "variant_id", "left")
    rival = F.element_at(F.create_map(*(F.lit(x) for kv in RIVALS.items() for x in kv)), F.col("variant_id"))
    mine = full.withColumn("rival", rival).filter("rival IS NOT NULL")
    theirs = full.select(F.col("variant_id").alias("rival"), *(F.col(x).alias(f"r_{x}") for x in ("average", "risks", "failures", *KEPT_DIMENSIONS)))
    base = full.filter("variant_id = 'baseline'").select(F.col("average").alias("b_average"), F.lit(1).alias("k"))
    won = c.groupBy(F.col("candidate").alias("variant_id"), F.col("baseline").alias("rival")).agg(F.count_if(F.col("preferred") == F.col("candidate")).alias("wins"))
    over_base = won.filter("rival = 'baseline'").select("variant_id", F.col("wins").alias("b_wins"))
    g = mine.join(theirs, "rival").join(won, ["variant_id", "rival"], "left").join(over_base, "variant_id", "left").withColumn("k", F.lit(1)).join(base, "k", "left").fillna(0, ["wins", "b_wins"])
    g = g.withColumn("delta", F.round(F.col("average") - F.col("r_average"), 3))
    context, clustering = F.col("variant_id") == "semantic-structure-context", F.col("variant_id") == "semantic-clustering"
    reasons = F.array_compact(F.array(
        F.when(F.col("delta") < DELTA, "score"), F.when(F.col("wins") < WINS, "wins"), F.when(~context & (F.col("failures") > F.col("r_failures")), "failures"), F.when(~context & (F.col("risks") > F.col("r_risks")), "risks"),
        F.when(context & (F.col("average") <= F.col("b_average")), "baseline"), F.when(context & (F.col("b_wins") < WINS), "baseline_wins"), F.when(~clustering & (F.col("errors") > 0), "validation"),
        *(F.when(context & (F.col(d) < F.col(f"r_{d}")), f"dimension:{d}") for d in KEPT_DIMENSIONS)))
    return g.select("variant_id", "rival", "delta", "wins", reasons.alias("reasons")).withColumn("passes", F.size("reasons") == 0)


def focus_coverage(tags: DataFrame) -> DataFrame:
    """(tag, cases, covered) of the required tags, from tags (case_id, tag)."""
    wanted = tags.sparkSession.createDataFrame([(x,) for x in FOCUS_TAGS], "tag string")
    return wanted.join(tags.groupBy("tag").agg(F.count_distinct("case_id").alias("n")), "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("cases"), F.col("n").isNotNull().alias("covered"))
