"""References to records that do not exist: direct orphans and what inherits from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions.paths import FILE, normal_node_id, normal_path, parent_dir
from repolith.session import cut

#: Rows of a level up to which it is broadcast to the nodes; a larger one meets them by a shuffle. A row has two ids, so this is some tens of MB at most.
BROADCAST_ROWS = 100_000
DIR = "dir::"
#: Statuses of a dependency that claims a target.
RESOLVED = ("resolved_exact", "resolved_heuristic")


def live_nodes(nodes: DataFrame) -> DataFrame:
    """(n_csc, n_id, n_from, n_to): distinct spans in which a node is live, ids in normal form."""
    return nodes.select(F.col("csc_id").alias("n_csc"), normal_node_id(F.col("node_id")).alias("n_id"),
                        F.col("recorded_at").alias("n_from"), F.col("removed_at").alias("n_to"))


def references(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Every reference that must name a live node: (ref_table, csc_id, record_key, ref_field, ref_id, at).

    Edges refer by source_id and target_id, where not null. Dependencies whose
    status is resolved (blanks and letter case ignored) refer to the file node of
    target_path; their ref_id is null where target_path is null.
    """
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("ref_id")) for c in ("source_id", "target_id"))), lambda r: r["ref_id"].isNotNull())
    of_edges = edges.select("csc_id", F.col("edge_id").alias("record_key"), F.col("recorded_at").alias("at"), F.explode(pairs).alias("r")).select(
        F.lit("graph_edges").alias("ref_table"), "csc_id", "record_key", "r.ref_field", normal_node_id(F.col("r.ref_id")).alias("ref_id"), "at")
    of_dependencies = dependencies.filter(F.lower(F.trim("resolution_status")).isin(*RESOLVED)).select(
        F.lit("dependency_records").alias("ref_table"), "csc_id", F.col("dependency_id").alias("record_key"), F.lit("target_path").alias("ref_field"),
        F.concat(F.lit(FILE), normal_path(F.col("target_path"))).alias("ref_id"), F.col("recorded_at").alias("at"))
    return of_edges.unionByName(of_dependencies)


def node_parents(nodes: DataFrame) -> DataFrame:
    """The containment reference of each node: (csc_id, node, parent, at).

    Symbols and chunks belong to the file of their path, files and directories to
    the directory above. Nodes without path, and top directories, refer to nothing.
    """
    path, kind = normal_path(F.col("path")), F.split_part(F.col("node_id"), F.lit("::"), F.lit(1))
    parent = F.when(kind.isin("file", "dir"), F.concat(F.lit(DIR), parent_dir(path))).otherwise(F.concat(F.lit(FILE), path))
    return nodes.select("csc_id", normal_node_id(F.col("node_id")).alias("node"), parent.alias("parent"), F.col("recorded_at").alias("at")).filter(
        F.col("parent").isNotNull() & (F.col("parent") != F.col("node")))


def _dead(refs: DataFrame, column: str, live: DataFrame) -> DataFrame:
    """The rows of refs whose column names no node live at `at`; null keys or times match nothing."""
    return refs.join(live, (refs.csc_id == live.n_csc) & (refs[column] == live.n_id) & (refs["at"] >= live.n_from)
                     & (live.n_to.isNull() | (refs["at"] < live.n_to)), "left_anti")


def direct_orphans(nodes: DataFrame, edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The base of the cascade: references of both tables to nodes that are not live at recorded_at.

    Distinct rows (ref_table, csc_id, record_key, ref_field, ref_id, at). One anti
    join with the time condition inside, so no list of a node's spans is built and
    a target with many references is split by the engine's skew handling.
    """
    return _dead(references(edges, dependencies), "ref_id", live_nodes(nodes)).distinct()


def orphan_cascade(nodes: DataFrame, edges: DataFrame, dependencies: DataFrame, max_depth: int = 64) -> DataFrame:
    """Direct and inherited orphans: (ref_table, csc_id, record_key, ref_field, recorded_at, kind, depth).

    kind `direct`, depth 0: the reference names no node live at recorded_at; for
    ref_table `graph_nodes` (ref_field `parent`) the node's container is not live
    when the node is recorded. kind `inherited`: the record refers to something
    that is itself an orphan, found by semi joins down the foreign keys: nodes of
    orphaned containers, level by level until a level is empty, then edges and
    dependencies that name an orphaned node; depth is the number of steps to the
    nearest direct orphan. A reference that is a direct orphan isn't inherited too.

    Nulls: a null csc_id, key or time matches no node, so such a reference is
    direct. Repeated rows count once. Empty tables give no rows. Only directories hold
    directories, so only they are iterated, a small part of the nodes; files
    and what they hold follow in one join each. A directory that is reached again at a later level
    keeps its least depth; paths grow with every level, so the levels end. max_depth only
    guards against foreign data and raises when reached. Levels are kept in
    the shared checkpoint folder; only their number of rows reaches the driver.
    """
    live, family = live_nodes(nodes), node_parents(nodes).distinct()
    node = ["csc_id", "node", "at"]
    orphaned = cut(_dead(family, "parent", live).select(*node)).withColumn("depth", F.lit(0))
    folders = cut(family.filter(F.col("node").startswith(DIR)))
    levels, frontier = [orphaned.filter(F.col("node").startswith(DIR))], orphaned.filter(F.col("node").startswith(DIR))
    while size := frontier.count():
        if len(levels) > max_depth:
            raise RuntimeError("containment has a cycle")
        frontier = cut(_children(folders, _nearest(frontier), size))
        levels.append(frontier)
    lost_folders = reduce(DataFrame.unionByName, levels)
    files = family.filter(F.col("node").startswith(FILE))
    lost_files = cut(orphaned.filter(F.col("node").startswith(FILE)).unionByName(_children(files, _nearest(lost_folders))))
    others = family.filter(F.col("parent").startswith(FILE))
    lost_others = orphaned.filter(~F.col("node").startswith(DIR) & ~F.col("node").startswith(FILE)).unionByName(_children(others, _nearest(lost_files)))
    lost = cut(lost_folders.unionByName(lost_files).unionByName(lost_others).groupBy(*node).agg(F.min("depth").alias("depth")))
    refs = references(edges, dependencies)
    direct = direct_orphans(nodes, edges, dependencies)
    out = ["ref_table", "csc_id", "record_key", "ref_field", F.col("at").alias("recorded_at"), "kind", "depth"]
    ids = _nearest(lost)
    heirs = refs.join(ids, (F.col("csc_id") == F.col("u_csc")) & (F.col("ref_id") == F.col("u_node"))).drop("u_csc", "u_node").distinct()
    heirs = _dead_not(heirs, live).select(*out[:4], F.col("at").alias("recorded_at"), F.lit("inherited").alias("kind"), (F.col("u_depth") + 1).alias("depth"))
    return (direct.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)}).select(*out)
            .unionByName(heirs)
            .unionByName(lost.select(F.lit("graph_nodes").alias("ref_table"), "csc_id", F.col("node").alias("record_key"), F.lit("parent").alias("ref_field"),
                                     F.col("at").alias("recorded_at"), F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("kind"), "depth")))


def _nearest(lost: DataFrame) -> DataFrame:
    """(u_csc, u_node, u_depth): the least depth of each orphaned id."""
    return lost.groupBy(F.col("csc_id").alias("u_csc"), F.col("node").alias("u_node")).agg(F.min("depth").alias("u_depth"))


def _children(family: DataFrame, above: DataFrame, size: int | None = None) -> DataFrame:
    """The nodes of family whose parent is one of above, a step deeper. size: rows of above, if known; few are broadcast."""
    above = F.broadcast(above) if size is not None and size <= BROADCAST_ROWS else above
    return family.join(above, (F.col("csc_id") == F.col("u_csc")) & (F.col("parent") == F.col("u_node"))).select("csc_id", "node", "at", (F.col("u_depth") + 1).alias("depth"))


def _dead_not(refs: DataFrame, live: DataFrame) -> DataFrame:
    """The rows of refs whose ref_id does name a live node."""
    return refs.join(live, (refs.csc_id == live.n_csc) & (refs.ref_id == live.n_id) & (refs["at"] >= live.n_from)
                     & (live.n_to.isNull() | (refs["at"] < live.n_to)), "left_semi")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of an orphan_cascade per table, field, kind and month of recorded_at (null month where it is null)."""
    return found.groupBy("ref_table", "ref_field", "kind", F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("orphans"), F.count_distinct("csc_id").alias("repositories"))
