"""Structure of repositories: files, directories, subsystems, symbols and the graph among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.functions.paths import FILE
from repolith.functions.text import lines, stripped

#: Lines of a code chunk.
CHUNK_LINES = 40


def files(scan: DataFrame) -> DataFrame:
    """(csc_id, path, language of the suffix), each file once."""
    return scan.select("csc_id", "path").filter("path IS NOT NULL").distinct().withColumn("language", language_of(F.col("path")))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of each key the first by the order, which must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def ancestors(path: Column) -> Column:
    """All directories above a path, the top one `.` first."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(F.size(parts) < 2, F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), upto))


def parent(path: Column) -> Column:
    """The directory of a path, `.` at the top; null for `.` itself."""
    return F.when(path == ".", None).when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def structure(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (csc_id, node_id, node_type, path) and edges (csc_id, edge_id, edge_type, source_id, target_id) of files and their directories."""
    f = files(scan)
    dirs = f.select("csc_id", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    nodes = dirs.select("csc_id", F.concat(F.lit("dir::"), "path").alias("node_id"), F.lit("directory").alias("node_type"), "path").unionByName(
        f.select("csc_id", F.concat(F.lit(FILE), "path").alias("node_id"), F.lit("file").alias("node_type"), "path"))
    up = F.concat(F.lit("dir::"), parent(F.col("path")))
    linked = nodes.filter("path <> '.'").select("csc_id", F.when(F.col("node_type") == "file", "contains").otherwise("parent_of").alias("edge_type"), up.alias("source_id"), F.col("node_id").alias("target_id"))
    return nodes, linked.select("csc_id", F.concat_ws("::", F.lit("edge"), "edge_type", "source_id", "target_id").alias("edge_id"), "edge_type", "source_id", "target_id")


def line_chunks(scan: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """(csc_id, path, chunk_id, line_start, line_end, text) of every `size` lines of a text; blank chunks are left out but counted. Null texts have none."""
    parts = scan.select("csc_id", "path", lines(F.col("text")).alias("ls")).filter(F.size("ls") > 0).distinct()
    at = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / size).cast("int"))))
    cut = at.select("csc_id", "path", (F.col("i") * size + 1).alias("line_start"), F.least((F.col("i") + 1) * size, F.size("ls")).alias("line_end"),
                    stripped(F.array_join(F.slice("ls", F.col("i") * size + 1, F.lit(size)), "\n")).alias("text"))
    return cut.filter("text <> ''").select("csc_id", "path", F.concat(F.lit("code::"), "path", F.lit("::"), "line_start", F.lit("-"), "line_end").alias("chunk_id"), "line_start", "line_end", "text")


def subsystem(path: Column) -> Column:
    """`subsystem::root::group`: the top directory and the one below it, `.` where there is none."""
    parts = F.split(path, "/")
    return F.concat(F.lit("subsystem::"), F.when(F.size(parts) > 1, parts[0]).otherwise("."), F.lit("::"), F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(2))).otherwise("."))


def subsystems(scan: DataFrame, most: int = 12) -> DataFrame:
    """(csc_id, subsystem_id, file_count, symbol_count, languages, first_files): first_files in order of path, at most `most`.

    Files are ranked before they are gathered, so a subsystem of any size gathers few.
    """
    own = first_rows(scan.filter("path IS NOT NULL").select("csc_id", "path", (F.size(F.coalesce("functions", F.array())) + F.size(F.coalesce("classes", F.array()))).alias("symbols")), ["csc_id", "path"], [F.desc("symbols")])
    grouped = own.select("*", subsystem(F.col("path")).alias("subsystem_id"), language_of(F.col("path")).alias("language"))
    keys = ["csc_id", "subsystem_id"]
    totals = grouped.groupBy(*keys, "language").agg(F.count("*").alias("n"), F.sum("symbols").alias("s")).groupBy(*keys).agg(
        F.sum("n").alias("file_count"), F.sum("s").alias("symbol_count"), F.array_sort(F.collect_list(F.struct("language", "n"))).alias("languages"))
    ranked = grouped.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).filter(F.col("r") <= most)
    firsts = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("first_files"))
    return totals.join(firsts, keys).select(*keys, "file_count", "symbol_count", F.transform("languages", lambda x: F.concat(x["language"], F.lit("="), x["n"])).alias("languages"), "first_files")


def rollup(scan: DataFrame) -> DataFrame:
    """(csc_id, directory, language, files, depth): files below every directory, by language. One row per file and ancestor, summed before the shuffle."""
    f = files(scan)
    return f.select("csc_id", "language", F.explode(ancestors(F.col("path"))).alias("directory")).groupBy("csc_id", "directory", "language").agg(F.count("*").alias("files")).withColumn(
        "depth", F.when(F.col("directory") == ".", 0).otherwise(F.size(F.split("directory", "/"))))


def symbols(scan: DataFrame) -> DataFrame:
    """(csc_id, node_id, path, kind, name): functions and classes of each file, each once, and a module symbol for files that have any."""
    f = scan.filter("path IS NOT NULL").select("csc_id", "path", F.coalesce("functions", F.array()).alias("fs"), F.coalesce("classes", F.array()).alias("cs"))
    named = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    module = F.when(F.size("fs") + F.size("cs") > 0, F.array(F.struct(F.lit("module").alias("kind"), stem.alias("name")))).otherwise(F.array())
    rows = f.select("csc_id", "path", F.explode(F.concat(named("fs", "function"), named("cs", "class"), module)).alias("s")).select("csc_id", "path", "s.kind", "s.name").filter("name IS NOT NULL").distinct()
    return rows.select("csc_id", F.concat_ws("::", F.lit("sym"), "path", "kind", "name").alias("node_id"), "path", "kind", "name")


def rebuild_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(csc_id, kind, path) to be rebuilt between two states (csc_id, path, digest): changed or new files, their directories, and directories that lost a file."""
    joined = old.select("csc_id", "path", F.col("digest").alias("was"), F.lit(True).alias("o")).join(new.select("csc_id", "path", "digest", F.lit(True).alias("n")), ["csc_id", "path"], "full_outer")
    moved = joined.filter(F.col("o").isNull() | F.col("n").isNull() | ~F.col("was").eqNullSafe(F.col("digest")))
    changed = moved.filter("n").select("csc_id", F.lit("file").alias("kind"), "path")
    left = new.select("csc_id", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    dirs = moved.select("csc_id", F.explode(ancestors(F.col("path"))).alias("path")).distinct().join(left, ["csc_id", "path"], "left_semi")
    return changed.unionByName(dirs.select("csc_id", F.lit("directory").alias("kind"), "path"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(csc_id, edge_id, edge_type, source_id, target_id) with both ends, each edge once."""
    return edges.select("csc_id", "edge_id", "edge_type", "source_id", "target_id").filter("source_id IS NOT NULL AND target_id IS NOT NULL").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(csc_id, node_id, edge_id, edge_type, neighbour) in both directions; an edge from a node to itself once."""
    e = distinct_edges(edges)
    back = e.filter("source_id <> target_id").select("csc_id", F.col("target_id").alias("node_id"), "edge_id", "edge_type", F.col("source_id").alias("neighbour"))
    return e.select("csc_id", F.col("source_id").alias("node_id"), "edge_id", "edge_type", F.col("target_id").alias("neighbour")).unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """(csc_id, node_id, outgoing, incoming, first_edge): the adjacency of each node in numbers, so that a hub gathers nothing."""
    e = distinct_edges(edges)
    ends = e.select("csc_id", F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "edge_id").unionByName(
        e.select("csc_id", F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "edge_id"))
    return ends.groupBy("csc_id", "node_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.min("edge_id").alias("first_edge"))


def expand(anchors: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 48) -> DataFrame:
    """(csc_id, anchor, node_id, distance, edge_id, via): nodes within 1 or 2 steps of each anchor (csc_id, anchor), at most `limit` for each.

    A node is found by the least (frontier node, edge_id) of the nearest level;
    nodes are cut in order of (distance, frontier node, edge_id). The anchor itself
    is no hit.

    Of a node's neighbours only the first 2 * limit + 2 by edge_id are followed,
    which changes nothing: where an anchor has fewer than limit neighbours itself, at
    most limit + 1 of those are seen already, and the others fill the limit. So a
    hub costs each anchor no more than that.
    """
    keys = ["csc_id", "anchor"]
    first = neighbours(edges).groupBy("csc_id", "node_id", "neighbour").agg(F.min("edge_id").alias("edge_id"))
    place = F.row_number().over(Window.partitionBy("csc_id", "node_id").orderBy("edge_id", "neighbour"))
    near = first.withColumn("place", place).filter(F.col("place") <= 2 * limit + 2).drop("place")
    seen = anchors.select(*keys, F.col("anchor").alias("node_id"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("string").alias("via")).distinct()
    frontier = seen
    for step in range(1, min(max(depth, 1), 2) + 1):
        found = frontier.select(*keys, F.col("node_id").alias("via")).join(near.withColumnRenamed("node_id", "via"), ["csc_id", "via"]).groupBy(*keys, F.col("neighbour").alias("node_id")).agg(F.min(F.struct("via", "edge_id")).alias("f"))
        frontier = found.join(seen.select(*keys, "node_id"), [*keys, "node_id"], "left_anti").select(*keys, "node_id", F.lit(step).alias("distance"), "f.edge_id", "f.via")
        seen = seen.unionByName(frontier)
    w = Window.partitionBy(*keys).orderBy("distance", "via", "edge_id", "node_id")
    return seen.filter("distance > 0").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")


def source_roots(scan: DataFrame, roots: list[str]) -> DataFrame:
    """(csc_id, root, status): every configured root in every repository, `analysed` where a file lies below it, else `missing`. A root outside the repository is an error."""
    for root in roots:
        if root.startswith(("/", "~")) or ".." in root.replace("\\", "/").split("/"):
            raise ValueError(f"source root outside the repository: {root}")
    wanted = [r.replace("\\", "/").strip("/").removeprefix("./") or "." for r in roots]
    below = F.array_compact(F.array(*(F.when(F.lit(r == ".") | F.startswith("path", F.lit(r + "/")), F.lit(r)) for r in wanted)))
    have = scan.filter("path IS NOT NULL").select("csc_id", F.explode(below).alias("root")).distinct().withColumn("h", F.lit("analysed"))
    every = scan.select("csc_id").distinct().select("csc_id", F.explode(F.array(*map(F.lit, wanted))).alias("root")).distinct()
    return every.join(have, ["csc_id", "root"], "left").select("csc_id", "root", F.coalesce("h", F.lit("missing")).alias("status"))


def scan_stream(scan: DataFrame, max_files: int) -> DataFrame:
    """(csc_id, path, n, symbols): the first `max_files` files of each repository in order of path with the number of symbols found in their text; a file that can't be read has none."""
    from repolith.operators import analyzers

    w = Window.partitionBy("csc_id").orderBy("path")
    first = files(scan).select("csc_id", "path", F.row_number().over(w).alias("n")).filter(F.col("n") <= max_files)
    found = analyzers.symbols(scan.join(first.select("csc_id", "path"), ["csc_id", "path"], "left_semi")).groupBy("csc_id", "path").agg(F.count("*").alias("symbols"))
    return first.join(found, ["csc_id", "path"], "left").select("csc_id", "path", "n", F.coalesce("symbols", F.lit(0)).alias("symbols"))
