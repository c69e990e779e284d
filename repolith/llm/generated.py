"""Generated, minified, vendored and data files among source files.

Vendored copies are found through an inverted index of line hashes: each file looks
up so many of its rarest lines that whatever holds enough of it holds one of them, and
is compared line by line with every file it meets. Token composition decides the other kinds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.session import cut, spread

#: Lines shorter than this, without blanks, say nothing of a file's origin.
LINE = 12
#: Distinct lines that a file needs to be judged a copy, and their share in the other file.
LINES, CONTAINMENT = 10, 0.8
#: Holders of a line that are looked up under one key; more are dealt out over several.
HOT = 1000

#: The marks by which tools sign their output, as whole comment lines of a file's beginning.
_SIGNED = re.compile(r"^[ \t]*(?://|#|/?\*|<!--)[ \t]*(?:Code generated .* DO NOT EDIT\.?[ \t]*(?:\*/|-->)?$|@generated\b|<auto-?generated\b)", re.M)
#: The comments that begin a file, of all languages, also behind a package line.
_HEADER = re.compile(r'\A﻿?(?:\s+|//[^\n]*|#(?!include|define|if|pragma|region)[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|(?:package|namespace)\s+[\w.]+\s*;?[ \t]*(?=\r?\n)|[\"']use strict[\"'];?)*")

_BESIDE_SIGNS = bytes(c for c in range(128) if chr(c).isalnum() or c in b"_ \t\r") + bytes(range(128, 256))
_BLANK, _DIGITS = b" \t\r\n\f\v", b"0123456789"
_NUMBERS = re.compile(rb"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*[\s,]*|\\x[0-9a-fA-F]{2}")
_BLOB = re.compile(rb"[A-Za-z0-9+/=\\]{80,}")
_INTEGERS = re.compile(rb"(?<![.\w])\d{1,6}(?![.\w])|(?<=[A-Za-z_])\d{1,6}(?!\d)")


def repetition(code: bytes) -> tuple[int, int]:
    """(lines outside, lines inside) sequences of three lines whose signs occur four times or more."""
    lines = [x for x in code.translate(None, _BESIDE_SIGNS).split(b"\n") if x]
    runs = list(zip(lines, lines[1:], lines[2:], strict=False))
    often = Counter(runs)
    inside = bytearray(len(lines))
    for i, run in enumerate(runs):
        if often[run] >= 4:
            inside[i : i + 3] = b"\1\1\1"
    n = sum(inside)
    return len(lines) - n, n


def numbered(code: bytes) -> int:
    """How far the integers of a text count up from 0 or 1, one by one in order, also as ends of names; others may stand between."""
    reached = 0
    for start in (0, 1):
        want = start
        for x in _INTEGERS.findall(code):
            want += int(x) == want
        reached = max(reached, want - start)
    return reached


def composition(text: str) -> str | None:
    """`data`, `minified`, `generated`, or None, from the signs and tokens of a whole text alone.

    Data: numbers, or runs of encoded bytes, make most of it. Minified: most of it
    is one line with few blanks. Generated: nearly all lines repeat the signs of
    others and their numbers count up, as a loop writes them, or a tool signed the
    file. People repeat lines too, as in tests, routes and word lists, but do not number them.
    """
    code = text.encode(errors="replace")
    n = len(code)
    if not n:
        return None
    blanks = n - len(code.translate(None, _BLANK))
    longest = max(map(len, code.split(b"\n")))
    if n >= 200:
        if len(code.translate(None, _DIGITS)) < 0.75 * n and n - len(_NUMBERS.sub(b"", code)) > 0.6 * n:
            return "data"
        if longest >= 80 and sum(map(len, _BLOB.findall(code))) > 0.5 * n:
            return "data"
    if longest > 200 and blanks < 0.12 * n and longest > 0.5 * n:
        return "minified"
    header = _HEADER.match(text)[0]
    if _SIGNED.search(header):
        return "generated"
    body = code[len(header.encode(errors="replace")) :]
    outside, inside = repetition(body)
    if inside >= 10 and inside > 0.8 * (inside + outside) and outside <= max(9, 0.05 * inside) and numbered(body) >= max(5, inside // 8):
        return "generated"
    return None


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["kind"] = [composition(t) for t in b["text"]]
        yield b[["csc_id", "path", "kind"]]


def source_texts(files: DataFrame) -> DataFrame:
    """(csc_id, path, text) of files with text and a suffix of the eight languages."""
    return files.select("csc_id", "path", "text").filter(F.col("text").isNotNull() & (language_of(F.col("path")) != "unknown"))


def line_hashes(text: Column) -> Column:
    """Distinct hashes of a text's lines of at least LINE signs, blanks not counted."""
    lines = F.filter(F.split(F.translate(text, " \t\r\f", ""), "\n"), lambda x: F.length(x) >= LINE)
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def copies_across_repositories(files: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """(csc_id, path, containment): files of which `least` of the lines stand in one file of another repository.

    containment is the greatest share of its lines that one file of another repository holds.
    Files with the same lines are one class, however many there are, and have 1
    where two repositories hold them. The others are compared exactly with every
    class that can reach the bound: of a class's lines that two repositories hold, s,
    a file that holds t or more of them holds one of the rarest s - t + 1. So
    each class looks up these lines among the classes that are not only in its own
    repository and have t lines or more, and is compared over all lines with each it meets;
    a class with s below t ends before that. The lookups of a line that more than
    HOT classes hold are dealt out over several keys; none is left out. Files of
    fewer than LINES lines are no copies. The texts are read and hashed once; the
    hashes go to the shared checkpoint folder. Null csc_id is a repository of its own.
    """
    texts = source_texts(files).select("csc_id", "path", F.xxhash64("csc_id").alias("repo"), line_hashes(F.col("text")).alias("lines")).filter(F.size("lines") >= LINES)
    known = cut(texts.select("csc_id", "path", "repo", "lines", F.xxhash64("lines").alias("cls")))
    classes = known.groupBy("cls").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.any_value("lines").alias("lines"))
    index = classes.select("lo", "hi", F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("df"), F.min("lo").alias("first"), F.max("hi").alias("last")).filter(
        "df > 1 AND first <> last").select("line", "df")
    bound = F.ceil(F.size("lines") * F.lit(least) - 1e-6).cast("int")  # never above the least count that passes the test of the share
    alone = classes.filter("lo = hi").select(F.col("cls").alias("own"), F.col("lo").alias("repo"), bound.alias("t"), F.explode("lines").alias("line"))
    shared = alone.join(index, "line").groupBy("own", "repo", "t").agg(F.array_sort(F.collect_list(F.struct("df", "line"))).alias("shared")).filter(F.size("shared") >= F.col("t"))
    asked = cut(shared.select("own", "repo", "t", F.explode(F.slice("shared", F.lit(1), F.size("shared") - F.col("t") + 1)).alias("r")).select("own", "repo", "t", "r.line", F.ceil(F.col("r.df") / HOT).cast("int").alias("keys")))
    held = classes.select(F.col("cls").alias("other"), F.expr("IF(lo = hi, lo, NULL)").alias("only"), F.size("lines").alias("n"), F.explode("lines").alias("line")).join(asked.select("line", "keys").distinct(), "line").select(
        "other", "only", "n", "line", F.pmod(F.xxhash64("other"), F.col("keys")).cast("int").alias("key"))
    pairs = asked.select("own", "repo", "t", "line", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key")).join(held, ["line", "key"]).filter(
        "own <> other AND n >= t AND (only IS NULL OR only <> repo)").select("own", "other").distinct()
    # both name lo and hi, so that all uses of the classes read the same exchange
    mine = classes.filter("lo = hi").select(F.col("cls").alias("own"), "lines")
    theirs = classes.filter("lo <= hi").select(F.col("cls").alias("other"), F.col("lines").alias("their_lines"))
    compared = pairs.join(mine, "own").join(theirs, "other").select(F.col("own").alias("cls"), (F.size(F.array_intersect("lines", "their_lines")) / F.size("lines")).alias("containment"))
    exact = known.groupBy("cls").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).filter("lo <> hi").select("cls", F.lit(1.0).alias("containment"))
    contained = compared.unionByName(exact).filter(F.col("containment") >= least).groupBy("cls").agg(F.max("containment").alias("containment"))
    return known.select("csc_id", "path", "cls").join(contained, "cls").select("csc_id", "path", F.round("containment", 6).alias("containment")).distinct()


def not_hand_written(files: DataFrame) -> DataFrame:
    """(csc_id, path, kind): source files that were not written by hand for their repository.

    kind is `data`, `minified`, `generated` or `vendored`; a file that is several
    has the first of these. Null and empty texts, and suffixes outside the eight
    languages, are no cases; repeated rows count once, and a path with several
    texts is a case if one of them is. Empty tables give no rows.
    """
    composed = spread(source_texts(files), "csc_id", "path").mapInPandas(_compose, "csc_id string, path string, kind string").filter("kind IS NOT NULL")
    copied = copies_across_repositories(files).select("csc_id", "path", F.lit("vendored").alias("kind"))
    return composed.unionByName(copied).groupBy("csc_id", "path").agg(F.min(F.struct(
        F.array_position(F.array(*map(F.lit, ("data", "minified", "generated", "vendored"))), F.col("kind")), "kind")).getField("kind").alias("kind"))


def kind_report(files: DataFrame) -> DataFrame:
    """Per csc_id and language of the suffix: source files, and how many of each kind are not hand-written."""
    cases = not_hand_written(files)
    all_files = source_texts(files).select("csc_id", "path").distinct()
    joined = all_files.join(cases, [all_files.csc_id.eqNullSafe(cases.csc_id), all_files.path == cases.path], "left").select(all_files.csc_id, all_files.path, "kind")
    return joined.groupBy("csc_id", language_of(F.col("path")).alias("language")).agg(
        F.count("*").alias("files"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("data", "minified", "generated", "vendored")))
