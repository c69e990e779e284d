"""A repository's texts as units for one model context: files whole, large files cut at lines, units in bins, and what can be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions.text import lines, tokens
from repolith.operators.history import greedy_bins


def line_units(files: DataFrame, budget: int) -> DataFrame:
    """(csc_id, path, line_start, line_end, token_count): spans of lines of each text (csc_id, path, text), as many lines as fit into the budget, at least one.

    The fold runs inside each row over the token counts of its lines. Texts
    without lines have no units; repeated files count once.
    """
    counted = files.select("csc_id", "path", "text").distinct().select("csc_id", "path", F.transform(lines(F.col("text")), lambda x: F.size(tokens(x))).alias("n")).filter(F.size("n") > 0)
    unit = "named_struct('first', acc.first, 'last', acc.at, 'total', acc.total)"
    folded = F.expr(f"""aggregate(n, named_struct('done', cast(array() AS array<struct<first: int, last: int, total: int>>), 'first', 1, 'at', 0, 'total', 0),
        (acc, x) -> IF(acc.at >= acc.first AND acc.total + x > {int(budget)}, named_struct('done', array_append(acc.done, {unit}), 'first', acc.at + 1, 'at', acc.at + 1, 'total', x),
                       named_struct('done', acc.done, 'first', acc.first, 'at', acc.at + 1, 'total', acc.total + x)),
        acc -> array_append(acc.done, {unit}))""")
    return counted.select("csc_id", "path", F.explode(folded).alias("u")).select("csc_id", "path", F.col("u.first").alias("line_start"), F.col("u.last").alias("line_end"), F.col("u.total").alias("token_count"))


def corpus(files: DataFrame, budget: int) -> DataFrame:
    """line_units with their bin: units in order of path and line, in bins of the budget."""
    return greedy_bins(line_units(files, budget), "csc_id", ["path", "line_start"], "token_count", budget)


def reusable(units: DataFrame, files: DataFrame) -> DataFrame:
    """(csc_id, source_path, reuse): whether the fingerprint that units carry is still that of the file's text."""
    told = units.groupBy("csc_id", "source_path").agg(F.max("file_fingerprint").alias("told"))
    now = files.groupBy("csc_id", F.col("path").alias("source_path")).agg(F.max(F.sha2("text", 256)).alias("now"))
    return told.join(now, ["csc_id", "source_path"], "left").select("csc_id", "source_path", F.coalesce(F.col("told") == F.col("now"), F.lit(False)).alias("reuse"))
