"""Lexical retrieval over chunks: postings, BM25, top-k with fallback, fusion of sources, reranking.

Chunks are keyed by (csc_id, chunk_id) and questions by (csc_id, question_id); a
question is asked of its own repository, so all joins carry csc_id and grow with
the data only in proportion.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.functions.text import bucket, quote, tokens
from repolith.session import spread

# Saturation and length normalisation of BM25.
K1, B = 1.5, 0.75
#: Chunks, and questions, of a repository that are scored against each other in one piece.
CELL = 4096
#: Words that tell what a question is after, in order of precedence.
INTENT_WORDS = {
    "change_impact": ["change", "changed", "changes", "commit", "commits", "diff", "difference", "differences", "update", "updates", "updated", "modify", "modified", "modifies", "impact", "impacted"],
    "dependency": ["depend", "dependency", "dependencies", "import", "imports"],
    "documentation": ["document", "documents", "section", "sections", "grounded", "trace", "traceability", "impact", "impacted"],
    "architecture": ["architecture", "module", "modules", "design", "overview"],
}
#: Edge types that a question of an intent may follow.
INTENT_EDGES = {
    "change_impact": ["changed_in", "impacts_section", "documents", "contains", "references"], "dependency": ["imports", "contains", "defines", "references"],
    "documentation": ["documents", "impacts_section", "contains", "references"], "architecture": ["contains", "parent_of", "defines", "references", "documents", "imports"],
    "implementation": ["defines", "contains", "references", "parent_of"],
}
#: What a source type adds to a score under an intent; all others add 0.01.
TYPE_BIAS = {
    ("change_impact", "sdd_section"): 0.08, ("change_impact", "code"): 0.05, ("change_impact", "file_summary"): 0.04, ("change_impact", "directory_summary"): 0.04, ("change_impact", "review_artifact"): 0.03,
    ("dependency", "code"): 0.06, ("dependency", "file_summary"): 0.03, ("dependency", "directory_summary"): 0.03,
    ("documentation", "sdd_section"): 0.07, ("documentation", "review_artifact"): 0.04,
    ("architecture", "directory_summary"): 0.06, ("architecture", "file_summary"): 0.06, ("architecture", "code"): 0.02,
    ("implementation", "code"): 0.07, ("implementation", "file_summary"): 0.03,
}
# Weights of a reranked score.
LEXICAL_WEIGHT, ANCHOR_WEIGHT, GRAPH_WEIGHT = 0.65, 0.20, 0.15


#: Columns of an index.
INDEXED = ["csc_id", "chunk_id", "source_type", "source_path", "line_start", "dl", "words"]


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Distinct chunks without metadata; of a key given twice the first by its columns."""
    cols = ["csc_id", "chunk_id", "source_type", "source_path", "text", "section_id", "line_start", "line_end"]
    return chunks.select(*cols).groupBy("csc_id", "chunk_id").agg(F.min(F.struct(*cols[2:])).alias("c")).select("csc_id", "chunk_id", "c.*")


def indexed(chunks: DataFrame) -> DataFrame:
    """(csc_id, chunk_id, source_type, source_path, line_start, dl, words) of chunks: their tokens in order, and how many.

    Texts are tokenised once, before repeated rows are reduced to one, and go no further;
    all that retrieval needs is read from these rows, which lie by chunk. Of a key given
    twice the first by its columns stays, texts being told apart by their digests.
    What is indexed already is given back.
    """
    if chunks.columns == INDEXED:
        return chunks
    texts = spread(chunks.select("csc_id", "chunk_id", "source_type", "source_path", "text", "section_id", "line_start", "line_end"), "csc_id", "chunk_id")
    rows = texts.select("csc_id", "chunk_id", F.struct("source_type", "source_path", F.md5("text").alias("digest"), "section_id", "line_start", "line_end", tokens(F.col("text")).alias("words")).alias("c"))
    return rows.groupBy("csc_id", "chunk_id").agg(F.min("c").alias("c")).select("csc_id", "chunk_id", "c.source_type", "c.source_path", "c.line_start", F.size("c.words").alias("dl"), "c.words")


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """(csc_id, chunk_id, term, tf); chunks without tokens have no rows."""
    return indexed(chunks).select("csc_id", "chunk_id", F.explode("words").alias("term")).groupBy("csc_id", "chunk_id", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(csc_id, chunk_id, dl): tokens of each chunk."""
    return indexed(chunks).select("csc_id", "chunk_id", "dl")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(csc_id, n, avgdl): chunks and mean length of each store."""
    return lengths(chunks).groupBy("csc_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """(csc_id, term, df)."""
    return term_frequencies(chunks).groupBy("csc_id", "term").agg(F.count("*").alias("df"))


def postings(chunks: DataFrame) -> DataFrame:
    """(csc_id, bucket, term, chunk_id, tf): the rows of a posting store, to be written partitioned by bucket."""
    return term_frequencies(chunks).select("csc_id", bucket(F.col("term")).alias("bucket"), "term", "chunk_id", "tf")


def bm25(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(csc_id, question_id, chunk_id, score) of all pairs that share a token, score rounded to 9 places.

    A term that a question repeats counts as often. Questions and postings meet on
    (csc_id, term); frequencies of documents are counted in the same aggregation
    that the scores need, over the terms asked for only.
    """
    index = indexed(chunks)
    asked = asked_terms(questions)
    tf = index.select("csc_id", "chunk_id", "dl", F.explode("words").alias("term")).groupBy("csc_id", "chunk_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")).join(asked.select("csc_id", "term").distinct(), ["csc_id", "term"], "left_semi")
    df = tf.groupBy("csc_id", "term").agg(F.count("*").alias("df"))
    per = tf.join(df, ["csc_id", "term"]).join(asked, ["csc_id", "term"]).join(corpus_stats(index), "csc_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return per.groupBy("csc_id", "question_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")


def asked_terms(questions: DataFrame) -> DataFrame:
    """(csc_id, question_id, term, times)."""
    return questions.select("csc_id", "question_id", F.explode_outer(tokens(F.col("question"))).alias("term")).filter("term IS NOT NULL").groupBy("csc_id", "question_id", "term").agg(F.count("*").alias("times"))


def tie_key() -> list[Column]:
    """Order of chunks of equal score."""
    return [F.col("source_path"), F.coalesce("line_start", F.lit(0)), F.col("chunk_id")]


def cells(rows: DataFrame, grid: DataFrame, own: str, other: str, key: str) -> DataFrame:
    """rows with the numbers of their cells in the repository's grid: the own one by the hash of a key, and a copy for each of the other axis."""
    many = lambda c: F.coalesce(F.col(c), F.lit(1))
    return rows.join(F.broadcast(grid), "csc_id", "left").select(*rows.columns, F.pmod(F.hash(key), many(f"{own}s")).alias(own), F.explode(F.sequence(F.lit(0), many(f"{other}s") - 1)).alias(other))


def scored_cell(chunks: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Of one cell's chunks the k best of each of its questions, as found; the first k by the tie key at score 0 where none scores, and for questions without id.

    chunks: rows of a cell with their tokens joined by blanks; asked: (question_id, term, times,
    df, total), the term '' telling the repository's chunks and tokens. Scores go by the
    formula of bm25; repeated places of a (chunk, term) are counted by sorting.
    """
    out = ["csc_id", "question_id", "chunk_id", "source_path", "line_start", "score"]
    kinds = pa.schema([*(chunks.schema.field(c) if c in chunks.column_names else asked.schema.field(c) for c in out[:-1]), pa.field("score", pa.float64())])
    if not len(chunks) or not len(asked):
        return kinds.empty_table()
    chunks = chunks.combine_chunks()
    chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[(c, "ascending") for c in ("source_path", "line_start", "chunk_id")], null_placement="at_start")).combine_chunks()
    column = lambda name: asked[name].to_numpy()
    terms, df = asked["term"].combine_chunks(), column("df").astype(float)
    own = pc.equal(terms, "").to_numpy(zero_copy_only=False)
    n, tokens_in_all = df[own][0], column("total")[own][0]
    known = pc.unique(terms)
    lists = pc.split_pattern(chunks["words"], " ").combine_chunks()
    place, at = pc.index_in(lists.flatten(), value_set=known), np.repeat(np.arange(len(chunks)), lists.value_lengths().to_numpy())
    hit = place.is_valid().to_numpy(zero_copy_only=False)
    pairs, tf = np.unique(at[hit] * len(known) + place.drop_null().to_numpy(), return_counts=True)
    chunk, term = np.divmod(pairs, len(known))
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * chunks["dl"].to_numpy()[chunk] / (tokens_in_all / n)))
    idf = np.where(own, 0.0, column("times") * np.log(1 + (n - df + 0.5) / (df + 0.5)))
    ids = asked["question_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    of, code = ids.indices.to_numpy(), pc.index_in(terms, value_set=known).to_numpy()
    order = np.argsort(of, kind="stable")
    named = chunks["chunk_id"].is_valid().to_numpy()
    which, rows, scores = [], [], []
    for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        weight = np.zeros(len(known))
        weight[code[mine]] = idf[mine]
        score = np.floor(np.bincount(chunk, weight[term] * part, len(chunks)) * 1e9 + 0.5) / 1e9
        found = np.flatnonzero((score > 0) & named)
        best = found[np.argsort(-score[found], kind="stable")[:k]]
        for places, told in ((best, score[best]), (np.arange(min(k, len(chunks))) if not len(best) or not asked["question_id"][int(mine[0])].is_valid else best[:0], None)):
            which.append(np.full(len(places), mine[0]))
            rows.append(places)
            scores.append(np.zeros(len(places)) if told is None else told)
    picked, whose = chunks.take(pa.array(np.concatenate(rows))), asked.take(pa.array(np.concatenate(which)))
    return pa.table([*(picked[c] if c in chunks.column_names else whose[c] for c in out[:-1]), pa.array(np.concatenate(scores))], schema=kinds)


def top_k(chunks: DataFrame, questions: DataFrame, k: int = 6, most: int = CELL) -> DataFrame:
    """(csc_id, question_id, rank, chunk_id, score): the k best chunks; a question that matches none gets its store's first k by the tie key at score 0.

    A chunk's tokens are never dealt out: chunks lie whole in cells of one repository, at
    most about `most` chunks by `most` questions, and the questions' terms come there with
    their frequencies of documents. A cell gives k rows a question, which alone are ranked.
    chunks: rows as indexed gives them, or raw ones, of which a key given twice has the
    first by its columns.
    """
    chunks, questions = chunks.filter("csc_id IS NOT NULL"), questions.filter("csc_id IS NOT NULL")
    members = chunks.select("csc_id", F.lit(1).alias("c"), F.lit(0).alias("q")).unionByName(questions.select("csc_id", F.lit(0).alias("c"), F.lit(1).alias("q")))
    grid = members.groupBy("csc_id").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(c) / most).cast("int")).alias(name) for c, name in (("c", "blocks"), ("q", "parts")))).filter("blocks > 1 OR parts > 1")
    key = ["csc_id", "block", "part"]
    if chunks.columns == INDEXED:
        rows = cells(chunks, grid, "block", "part", "chunk_id").select(*key, "chunk_id", "source_path", "line_start", "dl", "words")
    else:
        cols = ["source_type", "source_path", "text", "section_id", "line_start", "line_end"]
        placed = cells(chunks.select("csc_id", "chunk_id", *cols), grid, "block", "part", "chunk_id").repartition(*key)
        one = placed.groupBy(*key, "chunk_id").agg(F.min(F.struct(*cols)).alias("c"))
        rows = one.select(*key, "chunk_id", "c.source_path", "c.line_start", tokens(F.col("c.text")).alias("words")).withColumn("dl", F.size("words"))
    posted = rows.select("csc_id", "dl", F.explode(F.when(F.col("part") == 0, F.array_append(F.array_distinct("words"), ""))).alias("term"))
    known = posted.groupBy("csc_id", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    asked = questions.select("csc_id", "question_id", F.explode(F.array_append(tokens(F.col("question")), "")).alias("term")).groupBy("csc_id", "question_id", "term").agg(F.count("*").alias("times"))
    left = rows.select(*key, "chunk_id", "source_path", F.coalesce("line_start", F.lit(0)).cast("long").alias("line_start"), "dl", F.array_join("words", " ").alias("words"))
    right = cells(asked.join(known, ["csc_id", "term"]), grid, "part", "block", "question_id")
    kinds = T.StructType([left.schema["csc_id"], right.schema["question_id"], *(left.schema[c] for c in ("chunk_id", "source_path", "line_start")), T.StructField("score", T.DoubleType())])
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda x, y: scored_cell(x, y, k), kinds)
    ranks = Window.partitionBy("csc_id", "question_id", F.col("score") > 0).orderBy(F.desc("score"), *tie_key())
    ranked = found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).withColumn("best", F.max("score").over(Window.partitionBy("csc_id", "question_id")))
    return ranked.filter("score > 0 OR best = 0 OR question_id IS NULL").select("csc_id", "question_id", "rank", "chunk_id", "score")


def citations(chunks: DataFrame, most: int = 200) -> DataFrame:
    """(csc_id, chunk_id, source_path, line_start, line_end, quote)."""
    return chunks.select("csc_id", "chunk_id", "source_path", "line_start", "line_end", quote(F.col("text"), most).alias("quote"))


def intent(question: Column) -> Column:
    """The first intent of which the question has a word, else `implementation`."""
    words, out = tokens(question), F.lit("implementation")
    for name, told in reversed(INTENT_WORDS.items()):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, told))), name).otherwise(out)
    return out


def type_bias(intent_: Column, source_type: Column) -> Column:
    """What a source type adds under an intent."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable((f"{i}/{s}", v) for (i, s), v in TYPE_BIAS.items())))
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", intent_, source_type)), F.lit(0.01))


def prior_source(candidates: DataFrame, order: tuple[str, ...] = ("lexical", "hierarchy", "vector")) -> DataFrame:
    """Of candidates (csc_id, question_id, chunk_id, source, score) each chunk once, from the first source that has it, the best of that."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    w = Window.partitionBy("csc_id", "question_id", "chunk_id").orderBy(place, F.desc("score"))
    return candidates.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def rerank(lexical: DataFrame, graph: DataFrame, chunks: DataFrame, questions: DataFrame, anchors: DataFrame, k: int = 12) -> DataFrame:
    """(csc_id, question_id, rank, chunk_id, lexical_score, anchor_score, graph_score, type_bias, final_score, reason).

    lexical: (csc_id, question_id, chunk_id, score), scaled by the question's best;
    graph: (csc_id, question_id, chunk_id, graph_score); anchors: (csc_id,
    question_id, source_path), files named by the question. Scores are rounded to
    6 places before ranking, ties go by the tie key.
    """
    keys = ["csc_id", "question_id", "chunk_id"]
    best = lexical.groupBy("csc_id", "question_id").agg(F.max("score").alias("best"))
    lex = lexical.join(best, ["csc_id", "question_id"]).select(*keys, F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("lex"))
    pool = lex.join(graph, keys, "full_outer").join(questions.select("csc_id", "question_id", intent(F.col("question")).alias("intent")), ["csc_id", "question_id"])
    named = anchors.select("csc_id", "question_id", "source_path", F.lit(1.0).alias("anchor")).distinct()
    rows = pool.join(chunks.select("csc_id", "chunk_id", "source_type", "source_path", "line_start"), ["csc_id", "chunk_id"]).join(named, ["csc_id", "question_id", "source_path"], "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    scored = rows.select(*keys, "source_path", "line_start", zero("lex").alias("lexical_score"), zero("anchor").alias("anchor_score"), zero("graph_score").alias("graph_score"), type_bias(F.col("intent"), F.col("source_type")).alias("type_bias"),
                         F.when(F.col("graph_score").isNull(), "lexical").when(F.col("lex").isNull(), "graph").otherwise("lexical+graph").alias("reason"))
    final = F.round(LEXICAL_WEIGHT * F.col("lexical_score") + ANCHOR_WEIGHT * F.col("anchor_score") + GRAPH_WEIGHT * F.col("graph_score") + F.col("type_bias"), 6)
    w = Window.partitionBy("csc_id", "question_id").orderBy(F.desc("final_score"), *tie_key())
    return scored.withColumn("final_score", final).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("source_path", "line_start")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new does not have, and the rows of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def expanded(initial: DataFrame, seeds: DataFrame, links: DataFrame, summaries: DataFrame, k: int = 6) -> DataFrame:
    """(csc_id, question_id, rank, chunk_id, origin): a question's chunks and, up to 2 * k in all, the summaries of the parents, siblings and children of their nodes.

    initial: (csc_id, question_id, chunk_id, rank); seeds: (csc_id, question_id,
    node_id); links: (csc_id, parent, child); summaries: (csc_id, node_id, chunk_id,
    source_type, source_path). Summaries of directories come first, then paths, then
    ids. Of a node's children only the first 3 * k in this order can matter, as at
    most k of them are seeds, so a flat directory costs no question more than that.
    """
    keys, first = ["csc_id", "question_id"], F.when(F.col("source_type") == "directory_summary", 0).otherwise(1)
    order = [first, F.col("source_path"), F.col("chunk_id"), F.col("node_id")]
    told = links.join(summaries.select("csc_id", F.col("node_id").alias("child"), "chunk_id", "source_type", "source_path"), ["csc_id", "child"]).withColumnRenamed("child", "node_id")
    few = told.withColumn("n", F.row_number().over(Window.partitionBy("csc_id", "parent").orderBy(*order))).filter(F.col("n") <= 3 * k).drop("n")
    up = seeds.join(links.select("csc_id", "parent", F.col("child").alias("node_id")), ["csc_id", "node_id"]).select(*keys, "parent").distinct()
    heads = up.select(*keys, "parent").unionByName(seeds.select(*keys, F.col("node_id").alias("parent"))).distinct()
    pick = [*keys, "node_id", "chunk_id", "source_type", "source_path"]
    near = heads.join(few, ["csc_id", "parent"]).select(*pick).unionByName(up.select(*keys, F.col("parent").alias("node_id")).join(summaries, ["csc_id", "node_id"]).select(*pick)).distinct()
    fresh = near.join(seeds, [*keys, "node_id"], "left_anti").join(initial.select(*keys, "chunk_id"), [*keys, "chunk_id"], "left_anti")
    size = initial.groupBy(*keys).agg(F.count("*").alias("own"))
    ranked = fresh.join(size, keys).withColumn("rank", F.col("own") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= 2 * k)
    return initial.select(*keys, F.col("rank").cast("long").alias("rank"), "chunk_id", F.lit("initial").alias("origin")).filter(F.col("rank") <= 2 * k).unionByName(ranked.select(*keys, "rank", "chunk_id", F.lit("hierarchy").alias("origin")))
