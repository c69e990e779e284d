"""Fragments of the graph: what each file, section, commit and the other chunks contribute, and their fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.functions.paths import FILE
from repolith.functions.text import tokens


def symbol_rows(nodes: DataFrame) -> DataFrame:
    """(csc_id, path, symbol, kind, name, qualified, line) of distinct symbol nodes."""
    return nodes.filter("node_type = 'symbol' AND path IS NOT NULL AND symbol_name IS NOT NULL").select(
        "csc_id", "path", F.col("node_id").alias("symbol"), F.col("symbol_kind").alias("kind"), F.col("symbol_name").alias("name"), F.coalesce("qualified_name", "symbol_name").alias("qualified"), F.col("line_start").alias("line")).distinct()


def owners(symbols: DataFrame) -> DataFrame:
    """(csc_id, path, owner, member): symbols and those that their qualified names put them under; of equal names the one that is no module, then the first."""
    first = symbols.groupBy("csc_id", "path", "qualified").agg(F.min(F.struct((F.coalesce("kind", F.lit("")) == "module").alias("m"), "symbol")).alias("f")).select("csc_id", "path", F.col("qualified").alias("above"), F.col("f.symbol").alias("owner"))
    members = symbols.filter(F.col("qualified").contains(".")).select("csc_id", "path", F.col("symbol").alias("member"), F.regexp_replace("qualified", r"\.[^.]*$", "").alias("above")).distinct()
    return members.join(first, ["csc_id", "path", "above"]).filter("owner <> member").select("csc_id", "path", "owner", "member").distinct()


def chunk_references(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(csc_id, path, chunk_id, symbol): symbols of a chunk's file that begin within its lines, or whose name is one of its tokens."""
    c = chunks.filter("source_type = 'code'").select("csc_id", F.col("source_path").alias("path"), "chunk_id", "line_start", "line_end", F.array_distinct(tokens(F.col("text"))).alias("words"))
    begun = c.select("csc_id", "path", "chunk_id", "line_start", "line_end").distinct().join(symbols.select("csc_id", "path", "symbol", "line"), ["csc_id", "path"]).filter("line BETWEEN line_start AND line_end").select("csc_id", "path", "chunk_id", "symbol")
    said = c.select("csc_id", "path", "chunk_id", F.explode("words").alias("low")).distinct().join(symbols.select("csc_id", "path", "symbol", F.lower("name").alias("low")), ["csc_id", "path", "low"]).select("csc_id", "path", "chunk_id", "symbol")
    return begun.unionByName(said).distinct()


def file_fragments(scan: DataFrame, nodes: DataFrame, dependencies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(csc_id, fragment_id, edge_type, source_id, target_id): the edges of every scanned file's fragment.

    A file contains and defines its symbols, owners contain and are parents of their
    members, files import other known files, contain their chunks, and chunks refer to symbols.
    """
    known = scan.select("csc_id", "path").filter("path IS NOT NULL").distinct()
    symbols = symbol_rows(nodes).join(known, ["csc_id", "path"], "left_semi")
    file = F.concat(F.lit(FILE), "path")
    chunk = F.concat(F.lit("chunk::"), "chunk_id")
    rows = lambda df, types, source, target: df.select("csc_id", file.alias("fragment_id"), F.explode(F.array(*map(F.lit, types))).alias("edge_type"), source.alias("source_id"), target.alias("target_id"))
    imports = dependencies.filter("target_path IS NOT NULL AND target_path <> source_path").select("csc_id", F.col("source_path").alias("path"), "target_path").distinct().join(known, ["csc_id", "path"], "left_semi").join(
        known.select("csc_id", F.col("path").alias("target_path")), ["csc_id", "target_path"], "left_semi")
    code = chunks.filter("source_type = 'code'").select("csc_id", F.col("source_path").alias("path"), "chunk_id").distinct().join(known, ["csc_id", "path"], "left_semi")
    parts = [rows(symbols, ["contains", "defines"], file, F.col("symbol")), rows(owners(symbols), ["contains", "parent_of"], F.col("owner"), F.col("member")), rows(imports, ["imports"], file, F.concat(F.lit(FILE), "target_path")),
             rows(code, ["contains"], file, chunk), rows(chunk_references(chunks, symbols), ["references"], chunk, F.col("symbol"))]
    return reduce(DataFrame.unionByName, parts).distinct()


def other_fragments(scan: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(csc_id, fragment_id, edge_type, source_id, target_id): fragments of chunks other than code (no edges), of sections, and of commits.

    A section documents known files and symbols; a commit is where known files
    changed, and impacts the sections that document such a file.
    """
    known = scan.select("csc_id", F.concat(F.lit(FILE), "path").alias("id")).filter("path IS NOT NULL").distinct()
    targets = known.unionByName(symbol_rows(nodes).select("csc_id", F.col("symbol").alias("id"))).distinct()
    none = F.lit(None).cast("string")
    misc = chunks.filter("source_type <> 'code'").select("csc_id", F.lit("misc").alias("fragment_id"), none.alias("edge_type"), F.concat(F.lit("chunk::"), "chunk_id").alias("source_id"), none.alias("target_id"))
    e = edges.filter("source_id IS NOT NULL AND target_id IS NOT NULL").select("csc_id", "edge_type", "source_id", "target_id").distinct()
    documents = e.filter("edge_type = 'documents' AND source_id LIKE 'sdd_section::%'").join(targets.withColumnRenamed("id", "target_id"), ["csc_id", "target_id"], "left_semi")
    changed = e.filter("edge_type = 'changed_in' AND target_id LIKE 'commit::%'").join(known.withColumnRenamed("id", "source_id"), ["csc_id", "source_id"], "left_semi")
    impacts = changed.select("csc_id", F.col("source_id").alias("file"), F.col("target_id").alias("commit")).join(documents.select("csc_id", F.col("target_id").alias("file"), F.col("source_id").alias("section")), ["csc_id", "file"])
    out = ["csc_id", "fragment_id", "edge_type", "source_id", "target_id"]
    return (misc.distinct().unionByName(documents.withColumn("fragment_id", F.col("source_id")).select(*out)).unionByName(changed.withColumn("fragment_id", F.col("target_id")).select(*out))
            .unionByName(impacts.select("csc_id", F.col("commit").alias("fragment_id"), F.lit("impacts_section").alias("edge_type"), F.col("commit").alias("source_id"), F.col("section").alias("target_id")).distinct()))


def set_digest(*parts: Column) -> list[Column]:
    """Aggregates that tell of a set of distinct rows whatever their order: their number, and the sum and exclusive or of 60 bits of their digests, so that no group is gathered."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 15), 16, 10).cast("long")
    return [F.count("*").alias("members"), F.bit_xor(bits).alias("xor"), F.sum(F.pmod(bits, F.lit(1 << 31))).alias("total")]


def fingerprints(scan: DataFrame, dependencies: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(csc_id, fragment_id, members, fingerprint) of the structure, every file, the other chunks, every section and every commit.

    A fragment's members are distinct rows: of the structure its files, of a file its scans, imports and
    chunks, of a section its chunks and what it documents, of a commit its files.
    """
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = lambda df, fragment, *parts: df.select("csc_id", fragment.alias("fragment_id"), F.concat_ws("|", *parts).alias("row"))
    f = scan.filter("path IS NOT NULL")
    file = F.concat(F.lit(FILE), "path")
    chunk_parts = [F.lit("chunk"), s("chunk_id"), s("source_type"), s("line_start"), s("line_end"), F.sha2(s("text"), 256)]
    lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",") for c in ("functions", "classes", "imports")]
    rows = reduce(DataFrame.unionByName, [
        row(f, F.lit("structure"), F.col("path"), language_of(F.col("path"))), row(f, file, F.lit("scan"), s("language"), *lists, F.sha2(s("text"), 256)),
        row(dependencies.filter("source_path IS NOT NULL").withColumnRenamed("source_path", "path"), file, F.lit("import"), s("language"), s("dependency_kind"), s("raw_dependency"), s("normalized_key"), s("resolution_status"), s("target_path")),
        row(chunks.filter("source_type = 'code' AND source_path IS NOT NULL").withColumnRenamed("source_path", "path"), file, *chunk_parts), row(chunks.filter("source_type <> 'code'"), F.lit("misc"), *chunk_parts),
        row(chunks.filter("section_id IS NOT NULL"), F.concat(F.lit("sdd_section::"), "section_id"), *chunk_parts), row(edges.filter("edge_type = 'documents' AND source_id LIKE 'sdd_section::%'"), F.col("source_id"), F.lit("documents"), s("target_id")),
        row(edges.filter("edge_type = 'changed_in' AND target_id LIKE 'commit::%'"), F.col("target_id"), F.lit("changed"), s("source_id"))])
    g = rows.distinct().groupBy("csc_id", "fragment_id").agg(*set_digest(F.col("row")))
    return g.select("csc_id", "fragment_id", "members", F.sha2(F.concat_ws("|", "members", "xor", "total"), 256).alias("fingerprint"))


def evidence_targets(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(csc_id, path, name, symbol, found): names (csc_id, path, name) told of a file, as symbols of that file by name, qualified name or the end of it (`local`), else by name in any file, letter case aside (`global`)."""
    parts = F.split("qualified", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = symbols.select("csc_id", "path", "symbol", F.explode(F.array_distinct(F.concat(ends, F.array("name")))).alias("name")).distinct()
    local = refs.join(keyed, ["csc_id", "path", "name"]).withColumn("found", F.lit("local"))
    rest = refs.join(local.select("csc_id", "path", "name").distinct(), ["csc_id", "path", "name"], "left_anti").withColumn("low", F.lower("name"))
    away = rest.join(symbols.select("csc_id", F.lower("name").alias("low"), "symbol").distinct(), ["csc_id", "low"]).drop("low").withColumn("found", F.lit("global"))
    pick = ["csc_id", "path", "name", "symbol", "found"]
    return local.select(*pick).unionByName(away.select(*pick))


def anchor_symbols(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(csc_id, keys, symbol): the symbols that chunks (csc_id, keys, chunk_id, source_path, section_id) anchor.

    A chunk anchors its own node, its file's and its section's, where the graph has them; then the
    symbols one step from these over six types of edges, and all symbols of the files met.
    """
    types = ("references", "defines", "contains", "documents", "changed_in", "impacts_section")
    all_nodes = nodes.select("csc_id", "node_id").distinct()
    ids = F.array_compact(F.array(F.concat(F.lit("chunk::"), "chunk_id"), F.concat(F.lit(FILE), "source_path"), F.concat(F.lit("sdd_section::"), "section_id")))
    at = chunks.select("csc_id", *keys, F.explode(ids).alias("node_id")).distinct().join(all_nodes, ["csc_id", "node_id"], "left_semi")
    e = edges.filter(F.col("edge_type").isin(*types) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select("csc_id", "source_id", "target_id").distinct()
    both = e.select("csc_id", F.col("source_id").alias("node_id"), F.col("target_id").alias("near")).unionByName(e.select("csc_id", F.col("target_id").alias("node_id"), F.col("source_id").alias("near")))
    met = at.join(both, ["csc_id", "node_id"]).select("csc_id", *keys, F.col("near").alias("node_id")).join(all_nodes, ["csc_id", "node_id"], "left_semi")
    files = at.unionByName(met.select(*at.columns)).filter(F.col("node_id").startswith(FILE)).select("csc_id", *keys, F.substring("node_id", len(FILE) + 1, 1 << 20).alias("path")).distinct()
    of_files = files.join(symbol_rows(nodes).select("csc_id", "path", "symbol"), ["csc_id", "path"]).select("csc_id", *keys, "symbol")
    return met.filter(F.col("node_id").startswith("sym::")).select("csc_id", *keys, F.col("node_id").alias("symbol")).unionByName(of_files).distinct()


def canonical_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """links (keys, kind, reference, detail) each once, numbered in canonical order within the keys."""
    w = Window.partitionBy(*keys).orderBy("kind", "reference", F.coalesce("detail", F.lit("")))
    return links.distinct().withColumn("place", F.row_number().over(w))


def directory_texts(scan: DataFrame, links: DataFrame, rollup: DataFrame, most: int = 3) -> DataFrame:
    """(csc_id, directory, text): files, directories, languages, topics and first files below every directory in words. Topics and files are ranked before they are gathered."""
    from repolith.operators.repository import ancestors

    told = rollup.groupBy("csc_id", "directory").agg(F.sum("files").alias("files"), F.array_sort(F.collect_list(F.concat_ws("=", "language", "files"))).alias("languages"))  # nine languages at most
    files = scan.filter("path IS NOT NULL").select("csc_id", "path").distinct().select("csc_id", "path", F.explode(ancestors(F.col("path"))).alias("directory"))
    names = scan.filter("path IS NOT NULL").select("csc_id", F.explode(ancestors(F.col("path"))).alias("directory"), F.coalesce("classes", F.array().cast("array<string>")).alias("c")).select("csc_id", "directory", F.explode("c").alias("name")).distinct()

    def firsts(df: DataFrame, column: str) -> DataFrame:
        w = Window.partitionBy("csc_id", "directory").orderBy(column)
        return df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).groupBy("csc_id", "directory").agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(f"{column}s"))

    below = links.filter("edge_type = 'parent_of'").select("csc_id", F.substring("target_id", 6, 1 << 20).alias("path")).select("csc_id", F.explode(ancestors(F.col("path"))).alias("directory")).groupBy("csc_id", "directory").agg(F.count("*").alias("directories"))
    j = told.join(below, ["csc_id", "directory"], "left").join(firsts(files, "path"), ["csc_id", "directory"], "left").join(firsts(names, "name"), ["csc_id", "directory"], "left")
    text = F.concat(F.lit("Subtree files: "), "files", F.lit(". Subtree directories: "), F.coalesce("directories", F.lit(0)), F.lit(".\nLanguages: "), F.array_join("languages", ", "), F.lit(".\nKey topics: "), F.coalesce("names", F.lit("none")), F.lit(".\nRepresentative files: "), F.coalesce("paths", F.lit("none")), F.lit("."))
    return j.select("csc_id", "directory", text.alias("text"))
