"""Changes between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_digest(digest: Column) -> Column:
    """Digest in lower case without the algorithm name before `:`; null stays null."""
    return F.lower(F.regexp_replace(digest, "^[^:]*:", ""))


def snapshot_order(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """(workspace_id, checkpoint_id, ord, next_checkpoint_id, tree_sha, prev_tree_sha) of the delivered snapshots.

    Snapshots are numbered from 1 in the order of the instant of
    target_commit_timestamp, ties by checkpoint_id; instants that are null or
    unreadable come first. Checkpoints without rows are left out. A checkpoint
    given several times counts once, with its latest instant. The window holds
    one row per checkpoint, never the records of a snapshot.
    """
    known = checkpoints.groupBy("workspace_id", "checkpoint_id").agg(
        F.max(F.expr("try_cast(target_commit_timestamp AS timestamp_ltz)")).alias("at"), F.max("tree_sha").alias("tree_sha"))
    delivered = rows.select("workspace_id", "checkpoint_id").distinct()
    w = Window.partitionBy("workspace_id").orderBy(F.col("at").asc_nulls_first(), "checkpoint_id")
    return known.join(delivered, ["workspace_id", "checkpoint_id"]).select(
        "workspace_id", "checkpoint_id", F.row_number().over(w).alias("ord"), F.lead("checkpoint_id").over(w).alias("next_checkpoint_id"),
        "tree_sha", F.lag("tree_sha").over(w).alias("prev_tree_sha"))


def standing_rows(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """(workspace_id, fragment_id, ord, checkpoint_id, next_checkpoint_id, digest): the standing row of each fragment in each snapshot, spread by (workspace_id, fragment_id)."""
    keys = ["workspace_id", "fragment_id"]
    numbered = rows.select("workspace_id", "checkpoint_id", "fragment_id", "digest", "delivered_at").join(
        snapshot_order(checkpoints, rows).drop("tree_sha", "prev_tree_sha"), ["workspace_id", "checkpoint_id"])
    return numbered.select(*keys, "ord", "checkpoint_id", "next_checkpoint_id", F.struct("delivered_at", normal_digest(F.col("digest")).alias("digest")).alias("said")) \
        .repartition(*keys).groupBy(*keys, "ord", "checkpoint_id", "next_checkpoint_id").agg(F.max("said").getField("digest").alias("digest"))


def validity_intervals(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """Maximal runs of consecutive snapshots in which a fragment has one digest.

    Columns: workspace_id, fragment_id, digest, start_ord, end_ord,
    checkpoint_id (of start_ord), next_checkpoint_id (after end_ord, null at the
    workspace's end), prev_end (end_ord of the fragment's interval before) and
    next_start. Within a snapshot the row with the latest delivered_at stands,
    null delivered_at being the earliest, ties by the greatest digest with null
    least. Null fragment_id is one fragment; rows with null workspace_id or
    checkpoint_id belong to no snapshot. Null digests are equal to each other
    and to no other digest. No rows give no intervals.

    The rows are shuffled once, by (workspace_id, fragment_id): the choice of the
    standing row, both windows and the grouping into islands all reuse it. A
    workspace of any size spreads over all tasks.
    """
    keys = ["workspace_id", "fragment_id"]
    standing = standing_rows(checkpoints, rows)
    w = Window.partitionBy(*keys).orderBy("ord")
    goes_on = (F.lag("ord").over(w) == F.col("ord") - 1) & F.lag("digest").over(w).eqNullSafe(F.col("digest"))
    marked = standing.withColumn("starts", F.when(goes_on, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("starts").over(w)).groupBy(*keys, "island").agg(
        F.min("ord").alias("start_ord"), F.max("ord").alias("end_ord"), F.min_by("checkpoint_id", "ord").alias("checkpoint_id"),
        F.max_by("next_checkpoint_id", "ord").alias("next_checkpoint_id"), F.first("digest").alias("digest"))
    w = Window.partitionBy(*keys).orderBy("island")
    return islands.select(*keys, "digest", "start_ord", "end_ord", "checkpoint_id", "next_checkpoint_id",
                          F.lag("end_ord").over(w).alias("prev_end"), F.lead("start_ord").over(w).alias("next_start"))


def snapshot_changes(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """(workspace_id, checkpoint_id, fragment_id, change_kind), one row per change.

    An interval that starts after the first snapshot is `changed` where the
    fragment's interval before ends at the preceding snapshot, else `added`; an
    interval's end with no adjacent successor is `removed` at the next snapshot.
    The first snapshot of a workspace gives no rows, nor do empty tables.
    """
    spans = validity_intervals(checkpoints, rows)
    begun = F.when(F.col("start_ord") > 1, F.struct(
        "checkpoint_id", F.when(F.col("prev_end") == F.col("start_ord") - 1, "changed").otherwise("added").alias("change_kind")))
    ended = F.when(F.col("next_checkpoint_id").isNotNull() & ~F.coalesce(F.col("next_start") == F.col("end_ord") + 1, F.lit(False)), F.struct(
        F.col("next_checkpoint_id").alias("checkpoint_id"), F.lit("removed").alias("change_kind")))
    return spans.select("workspace_id", "fragment_id", F.explode(F.array_compact(F.array(begun, ended))).alias("e")) \
        .select("workspace_id", "e.checkpoint_id", "fragment_id", "e.change_kind")


def change_summary(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """Per later snapshot: counts of each change kind and whether tree_sha changed; snapshots without changes have zeros."""
    counts = snapshot_changes(checkpoints, rows).groupBy("workspace_id", "checkpoint_id").agg(
        *(F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "changed")))
    order = snapshot_order(checkpoints, rows).filter("ord > 1").select(
        "workspace_id", "checkpoint_id", (~F.col("tree_sha").eqNullSafe(F.col("prev_tree_sha"))).alias("tree_changed"))
    return order.join(counts, ["workspace_id", "checkpoint_id"], "left").fillna(0, ["added", "removed", "changed"])
