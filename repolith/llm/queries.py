"""Queries p1, p3, p4, p5, p7, p8 and p9 on their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.llm import bpe, generated, leakage, packing, splitting, syntax, truncation
from repolith.session import load

QUERIES, SQL = {}, {}


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Source files that were not written by hand for their repository."""
    return generated.not_hand_written(load(spark, d, "scan_records")).select("csc_id", "path")


@query
def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same files with what they are."""
    return generated.not_hand_written(load(spark, d, "scan_records"))


@query
def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    """Files contained in a file of another repository."""
    return generated.copies_across_repositories(load(spark, d, "scan_records"))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of files per repository and language."""
    return generated.kind_report(load(spark, d, "scan_records"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are too large and come out in pieces."""
    return splitting.split_chunks(load(spark, d, "knowledge_chunks")).select("csc_id", "chunk_id").distinct()


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every chunk that is too large."""
    return splitting.split_chunks(load(spark, d, "knowledge_chunks"))


@query
def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of every cut chunk what its pieces hold together, and the pieces that break a rule."""
    pieces = splitting.split_chunks(load(spark, d, "knowledge_chunks")).withColumn("tokens", F.regexp_count("text", F.lit(splitting.TOKEN)))
    before = F.lag("char_end").over(Window.partitionBy("csc_id", "chunk_id").orderBy("piece"))
    return pieces.withColumn("gap", F.coalesce(F.col("char_start") > before, F.col("char_start") > 0)).groupBy("csc_id", "chunk_id").agg(
        F.max("char_end").alias("characters"), F.sum(F.col("tokens") - F.col("overlap_tokens")).alias("tokens"), F.count_if("gap").alias("gaps"),
        F.count_if(F.col("tokens") > splitting.LIMIT).alias("too_large"), F.count_if((F.col("piece") > 0) & ~F.col("overlap_tokens").between(splitting.LEAST, splitting.MOST)).alias("badly_repeated"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Scanned files whose text does not parse."""
    return syntax.checked_files(load(spark, d, "scan_records")).filter("error IS NOT NULL").select("csc_id", "path").distinct()


@query
def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every file of the eight languages with what is wrong with it, null if nothing, and what told so: the lexer and its stack, declarations of another language, or the parser."""
    error = F.col("error")
    basis = F.when(error == "foreign_language", "declarations").when(error.isin("indentation", "invalid_syntax"), "parser").when(error.isNotNull(), "lexer")
    return syntax.checked_files(load(spark, d, "scan_records")).withColumn("basis", basis)


@query
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Rates of files that do not parse per repository and language."""
    return syntax.syntax_report(load(spark, d, "scan_records"), load(spark, d, "graph_nodes"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_units(load(spark, d, "corpus_units"), load(spark, d, "scan_records"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Units that no container holds whole."""
    return _packed(spark, d).filter("parts > 1").select("csc_id", "source_path", "line_start").distinct()


@query
def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every part of every unit with its container."""
    return _packed(spark, d)


@query
def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per repository what its containers hold together, and the containers and units that break a rule."""
    packed = _packed(spark, d)
    loads = packed.groupBy("csc_id", "container").agg(F.sum("size").alias("load")).groupBy("csc_id").agg(F.sum("load").alias("tokens"), F.count_if(F.col("load") > packing.CAPACITY).alias("overfull"))
    units = packed.groupBy("csc_id", "source_path", "line_start").agg(F.sum("size").alias("size"), F.count("*").alias("parts"), F.max("parts").alias("told")).groupBy(F.col("csc_id").alias("u_csc")).agg(
        F.count("*").alias("units"), F.count_if((F.col("parts") != F.col("told")) | (F.col("parts") > 1) & (F.col("size") <= packing.CAPACITY)).alias("torn"))
    return loads.join(units, F.col("csc_id").eqNullSafe(F.col("u_csc"))).select("csc_id", "units", "tokens", "overfull", "torn")


@query
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and filled share per repository."""
    return packing.packing_report(_packed(spark, d))


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document."""
    return bpe.encode(load(spark, d, "documents"))



def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items whose prompts they contain."""
    return _leaks(spark, d).filter("exact").select("doc_id", "item_id").distinct()


@query
def p8_regions(spark: SparkSession, d: str) -> DataFrame:
    """Exact leaks and near copies with their aligned regions."""
    return _leaks(spark, d)


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents per source."""
    return leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))



@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.scored(load(spark, d, "documents")).filter(f"score >= {truncation.CUT}").select("doc_id").distinct()


@query
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document with text."""
    return truncation.scored(load(spark, d, "documents"))


@query
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut texts per source."""
    return truncation.cut_share(load(spark, d, "documents"))


_TOKENS = "len(regexp_extract_all({0}, '[A-Za-z0-9_]+'))"
SQL["p3_found"] = f"SELECT DISTINCT csc_id, chunk_id FROM knowledge_chunks WHERE {_TOKENS.format('text')} > 400"
SQL["p5_found"] = f"""SELECT u.csc_id, u.source_path, u.line_start FROM corpus_units u LEFT JOIN scan_records s ON s.csc_id = u.csc_id AND s.path = u.source_path
GROUP BY ALL HAVING coalesce(max(u.token_count), max({_TOKENS.format('s.text')}), 0) > 1024"""

SQL["p3_cover"] = f"""SELECT DISTINCT csc_id, chunk_id, length(text) AS characters, {_TOKENS.format('text')} AS tokens, 0 AS gaps, 0 AS too_large, 0 AS badly_repeated
FROM knowledge_chunks WHERE {_TOKENS.format('text')} > 400"""
SQL["p5_whole"] = f"""WITH units AS (SELECT u.csc_id, u.source_path, u.line_start, coalesce(max(u.token_count), max({_TOKENS.format('s.text')}), 0) AS n
  FROM corpus_units u LEFT JOIN scan_records s ON s.csc_id = u.csc_id AND s.path = u.source_path GROUP BY ALL)
SELECT csc_id, count(*) AS units, sum(n) AS tokens, 0 AS overfull, 0 AS torn FROM units GROUP BY csc_id"""
