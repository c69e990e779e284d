"""Stores of chunks, postings and graphs as Parquet folders, and files and JSON lines as sources."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.functions.globs import ignored, matches
from repolith.functions.languages import language_of
from repolith.operators import retrieval

CHUNKS = T.StructType([T.StructField(n, t) for n, t in (
    ("csc_id", T.StringType()), ("chunk_id", T.StringType()), ("source_type", T.StringType()), ("source_path", T.StringType()), ("text", T.StringType()), ("section_id", T.StringType()),
    ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("metadata", T.MapType(T.StringType(), T.StringType())))])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, a line that is no object of the schema's types is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_files(spark: SparkSession, root: str, include: list[str], exclude: list[str], ignore: list[str] = ()) -> DataFrame:
    """(path, language, text) of the files below a folder: not ignored by the lines of `ignore`, not excluded, and included or of no known language; undecodable signs are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = PurePosixPath(root.removeprefix("file:")).as_posix().rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base), "")
    f = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text")).withColumn("language", language_of(F.col("path")))
    return f.filter(~ignored(F.col("path"), [*ignore, ".git/"]) & ~matches(F.col("path"), exclude) & (matches(F.col("path"), include) | (F.col("language") == "unknown"))).select("path", "language", "text")


def write_store(chunks: DataFrame, folder: str) -> None:
    """A retrieval store: chunks by repository, postings by bucket, and a row of statistics for each repository, which is written last."""
    rows = retrieval.chunk_rows(chunks)
    rows.write.mode("overwrite").partitionBy("csc_id").parquet(f"{folder}/chunks")
    retrieval.postings(rows).repartition("bucket").sortWithinPartitions("bucket", "csc_id", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    retrieval.corpus_stats(rows).write.mode("overwrite").parquet(f"{folder}/manifest")


def read_postings(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """Postings of a few terms, read from their buckets only."""
    from repolith.functions.text import bucket

    asked = spark.createDataFrame([(t,) for t in terms], "term string").select("term", bucket(F.col("term")).alias("bucket"))
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # as many as terms asked for
    return spark.read.parquet(f"{folder}/postings").filter(F.col("bucket").isin(buckets)).join(asked, ["bucket", "term"])


def overwrite_fragments(fragments: DataFrame, folder: str) -> None:
    """Write the given fragments, partitioned by fragment_group, in place of their groups only."""
    fragments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fragment_group").parquet(folder)


def load_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """nodes, edges, adjacency and symbols of a graph store; the last two are derived from edges and nodes where their tables are missing or can't be read."""
    from repolith.operators import fragments, repository

    nodes, edges = (spark.read.parquet(f"{folder}/{t}") for t in ("nodes", "edges"))

    def side(name: str, derived: DataFrame) -> DataFrame:
        try:
            return spark.read.parquet(f"{folder}/{name}").select(*derived.columns)
        except Exception:  # noqa: BLE001  whatever is wrong with a side table, the store's own tables hold the same
            return derived

    return {"nodes": nodes, "edges": edges, "adjacency": side("adjacency", repository.neighbours(edges)), "symbols": side("symbols", fragments.symbol_rows(nodes))}


def read_fragments(rows: DataFrame) -> DataFrame:
    """Rows (fragment_id, row_type, payload) of fragments, sound ones; a payload that is no JSON object, or a fragment without its meta row, is an error when read."""
    kinds = F.col("row_type").isin("meta", "node", "edge")
    parsed = F.try_parse_json("payload") if hasattr(F, "try_parse_json") else F.from_json("payload", "map<string,string>")
    sound = rows.filter(F.when(kinds & parsed.isNotNull() & F.trim("payload").startswith("{"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("corrupt row in fragment "), F.coalesce("fragment_id", F.lit("?")))).cast("boolean")))
    headed = sound.groupBy("fragment_id").agg(F.count_if(F.col("row_type") == "meta").alias("metas"))
    checked = headed.filter(F.when(F.col("metas") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("fragment without one meta row: "), "fragment_id")).cast("boolean"))).select("fragment_id")
    return sound.join(checked, "fragment_id", "left_semi")
