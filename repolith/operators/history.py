"""Commits and checkpoints: what they touch, how much they matter, and how records live through them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.functions.paths import FILE, normal_path
from repolith.operators.repository import subsystem
from repolith.operators.snapshots import standing_rows

#: Words in a file's name that tell of a variant; statuses in order of precedence.
VARIANTS = ("strategy", "variant", "policy", "mode", "backend", "adapter")
STATUSES = ("introduced", "retired", "modified", "observed", "unchanged")


def commit_files(edges: DataFrame) -> DataFrame:
    """(csc_id, commit_id, path, at): files that edges say were changed in a commit, with the commit's first mention."""
    e = edges.filter("edge_type = 'changed_in' AND target_id LIKE 'commit::%' AND source_id LIKE 'file::%'")
    return e.select("csc_id", F.col("target_id").alias("commit_id"), normal_path(F.substring("source_id", len(FILE) + 1, 1 << 20)).alias("path"), F.col("recorded_at").alias("at")).groupBy("csc_id", "commit_id", "path").agg(F.min("at").alias("at"))


def commit_deltas(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(csc_id, commit_id, at, files, subsystems, build_files, variants, signals, strength): signals in alphabetical order.

    strength is 3 for each signal, 2 for each subsystem and each build file, and 1 for each of up to four files.
    """
    f = commit_files(edges)
    importing = dependencies.select("csc_id", F.col("source_path").alias("path")).distinct().withColumn("imports", F.lit(True))
    known = f.join(importing, ["csc_id", "path"], "left")
    stem = F.regexp_extract(F.lower("path"), r"([^/]*?)(?:\.[^./]*)?$", 1)
    variant = reduce(lambda a, b: a | b, (stem.contains(v) for v in VARIANTS))
    g = known.groupBy("csc_id", "commit_id").agg(
        F.min("at").alias("at"), F.count("*").alias("files"), F.count_distinct(subsystem(F.col("path"))).alias("subsystems"), F.count_if(language_of(F.col("path")) == "unknown").alias("build_files"), F.count_if(variant).alias("variants"),
        F.max(F.coalesce("imports", F.lit(False))).alias("dep"), F.max(F.col("path").rlike(r"\.(h|hpp|ts)$")).alias("face"))
    signals = F.array_compact(F.array(F.when(F.col("variants") > 0, "algorithm"), F.when(F.col("subsystems") > 1, "architectural"), F.when(F.col("dep"), "dependency"), F.when(F.col("build_files") > 0, "infrastructure"), F.when(F.col("face"), "interface")))
    s = g.withColumn("signals", signals).drop("dep", "face")
    return s.withColumn("strength", F.size("signals") * 3 + F.col("subsystems") * 2 + F.col("build_files") * 2 + F.least("files", F.lit(4)))


def significance(score: Column) -> Column:
    """`high` from 10, `medium` from 6, else `low`."""
    return F.when(score >= 10, "high").when(score >= 6, "medium").otherwise("low")


def strong_commits(deltas: DataFrame) -> DataFrame:
    """deltas with i and island: the strong commits, those of one island following each other.

    Strong is what reaches the third highest strength of the repository, at least 6;
    where nothing does, the first of the strongest commits.
    """
    order = Window.partitionBy("csc_id").orderBy("at", "commit_id")
    best = Window.partitionBy("csc_id").orderBy(F.desc("strength"), "at", "commit_id")
    ranked = deltas.select("*", F.row_number().over(order).alias("i"), F.row_number().over(best).alias("r"))
    line = ranked.groupBy("csc_id").agg(F.greatest(F.lit(6), F.min(F.when(F.col("r") <= 3, F.col("strength")))).alias("line"), F.max("strength").alias("top"))
    strong = ranked.join(line, "csc_id").filter((F.col("strength") >= F.col("line")) | ((F.col("top") < F.col("line")) & (F.col("r") == 1)))
    return strong.withColumn("island", F.col("i") - F.row_number().over(order))


def strong_windows(deltas: DataFrame) -> DataFrame:
    """(csc_id, window, commits, first_commit, last_commit, strength): runs of consecutive strong commits."""
    w = Window.partitionBy("csc_id").orderBy("first")
    runs = strong_commits(deltas).groupBy("csc_id", "island").agg(F.count("*").alias("commits"), F.min("i").alias("first"), F.min_by("commit_id", "i").alias("first_commit"), F.max_by("commit_id", "i").alias("last_commit"), F.sum("strength").alias("strength"))
    return runs.select("csc_id", F.row_number().over(w).alias("window"), "commits", "first_commit", "last_commit", "strength")


def lifecycle(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """(workspace_id, fragment_id, checkpoint_id, status): what each snapshot says of each fragment of it and of the one before.

    `observed` in a workspace's first snapshot, then `introduced`, `modified`, `unchanged` or `retired`.
    """
    s = standing_rows(checkpoints, rows)
    w = Window.partitionBy("workspace_id", "fragment_id").orderBy("ord")
    near = s.select("*", F.lag("ord").over(w).alias("po"), F.lag("digest").over(w).alias("pd"), F.lead("ord").over(w).alias("no"))
    here = F.when(F.col("ord") == 1, "observed").when(F.col("po").isNull() | (F.col("po") != F.col("ord") - 1), "introduced").when(F.col("pd").eqNullSafe(F.col("digest")), "unchanged").otherwise("modified")
    gone = F.when(F.col("next_checkpoint_id").isNotNull() & (F.col("no").isNull() | (F.col("no") != F.col("ord") + 1)), F.struct(F.col("next_checkpoint_id").alias("checkpoint_id"), (F.col("ord") + 1).alias("ord"), F.lit("retired").alias("status")))
    both = F.array_compact(F.array(F.struct("checkpoint_id", "ord", here.alias("status")), gone))
    return near.select("workspace_id", "fragment_id", F.explode(both).alias("x")).select("workspace_id", "fragment_id", "x.checkpoint_id", "x.ord", "x.status")


def first_and_last(life: DataFrame) -> DataFrame:
    """(workspace_id, fragment_id, first_seen, last_updated, status): checkpoints carried forward over a lifecycle; status is the first in precedence that occurred."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return life.groupBy("workspace_id", "fragment_id").agg(
        F.min_by("checkpoint_id", "ord").alias("first_seen"), F.max_by("checkpoint_id", F.when(F.col("status") != "unchanged", F.col("ord"))).alias("last_updated"), F.min_by("status", place).alias("status"))


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, spans): spans (keys, start, end) merged where they overlap or touch."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("island")


def clipped(excerpts: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, excerpt, start, end, segment): excerpts (keys, excerpt, a, z) cut to the first segment (keys, segment, start, end) that they overlap; others are dropped."""
    met = excerpts.join(segments, keys).filter("a <= end AND z >= start")
    w = Window.partitionBy(*keys, "excerpt").orderBy("start", "segment")
    first = met.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return first.select(*keys, "excerpt", F.greatest("a", "start").alias("start"), F.least("z", "end").alias("end"), "segment")


def greedy_bins(units: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """units with `bin`: in order, a unit that does not fit into the open bin of its key opens the next.

    Greedy filling depends on all that came before, so a key is one task's stream:
    rows are sorted, which spills, and pass by with one running sum in memory.
    """
    names = units.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, bin_, load = object(), 0, 0
        for b in batches:
            out = []
            for k, s in zip(b[key], b[size].fillna(0), strict=True):
                if k != key_now:
                    key_now, bin_, load = k, 0, 0
                elif load and (load + s > budget or load >= budget):
                    bin_, load = bin_ + 1, 0
                load += s
                out.append(bin_)
            yield b.assign(bin=out)

    schema = ", ".join(f"`{n}` {t}" for n, t in units.dtypes)
    return units.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema + ", bin long").select(*names, "bin")
