"""Diffs, what their lines change, and the sections of a document that a change concerns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.functions.text import lines, stripped

# What a changed line looks like that touches a signature or a dependency, and how comments begin.
SIGNATURES = {
    "python": [r"^(def|class)\s+\w+"],
    "java": [r"^(class|interface|enum)\s+\w+", r"^(public|protected|private|static|final|abstract|synchronized|native|strictfp|\s)*[A-Za-z_][\w<>,\[\]\s]*\s+[A-Za-z_]\w*\s*\([^;]*\)\s*(\{|throws|$)"],
    "cpp": [r"^(class|struct)\s+\w+", r"^(template\s*<.*>\s*)?[A-Za-z_:~][\w:\<\>\*&\s]*\s+[A-Za-z_~]\w*\s*\([^;{}]*\)\s*(const)?\s*(\{|;)$"],
    "javascript": [r"^(export\s+)?(async\s+)?function\s+\w+", r"^class\s+\w+", r"^(const|let|var)\s+\w+\s*=\s*(async\s*)?\([^)]*\)\s*=>"],
    "typescript": [r"^(export\s+)?(async\s+)?function\s+\w+", r"^(export\s+)?(class|interface|type)\s+\w+", r"^(const|let|var)\s+\w+\s*:\s*.+="],
    "go": [r"^func\s+\w+\s*\(", r"^func\s*\([^)]*\)\s*\w+\s*\(", r"^type\s+\w+\s+(struct|interface)\b"],
    "rust": [r"^(pub\s+)?fn\s+\w+", r"^(pub\s+)?(struct|enum|trait)\s+\w+", r"^impl\s+"],
    "csharp": [r"^(class|interface|struct|enum|record)\s+\w+", r"^(public|private|protected|internal|static|virtual|override|sealed|abstract|partial|\s)+[A-Za-z_][\w<>,\[\]\s]*\s+[A-Za-z_]\w*\s*\([^;]*\)\s*(\{|$)"],
    "unknown": [r"^(def|class|interface|enum|struct|template|fn|func|impl)\b"],
}
DEPENDENCIES = {
    "python": [r"^(from\s+\S+\s+import\s+.+|import\s+.+)$"], "java": [r"^(import|package)\s+[A-Za-z0-9_.*]+\s*;"],
    "cpp": [r"^#\s*(include|import)\s*[<\"].+[>\"]", r"^using\s+namespace\s+[A-Za-z_][\w:]*\s*;"],
    "javascript": [r"^import\s+.+\s+from\s+['\"].+['\"]", r"^const\s+\w+\s*=\s*require\(['\"].+['\"]\)"],
    "typescript": [r"^import\s+.+\s+from\s+['\"].+['\"]", r"^export\s+.+\s+from\s+['\"].+['\"]"],
    "go": [r"^import\s+\(", r"^import\s+['\"].+['\"]"], "rust": [r"^use\s+[A-Za-z0-9_:{}*,\s]+;", r"^extern\s+crate\s+\w+;"],
    "csharp": [r"^(global\s+)?using\s+[A-Za-z0-9_.]+\s*;", r"^extern\s+alias\s+\w+\s*;"],
    "unknown": [r"^(import|from\s+\S+\s+import|#\s*include|include|package|using|use)\b"],
}
COMMENTS = {"python": ["#"], "unknown": ["#", "//", "/*", "*", "*/"]}
SLASHES = ["//", "/*", "*", "*/"]
DECLARING = ("def", "class", "interface", "struct", "enum", "fn", "func")
SECTIONS = {"interface_change": "Interface Design", "logic_change": "Detailed Design", "dependency_change": "Design Overview", "documentation_only": "Referenced Documents", "unknown": "Detailed Design"}


def looks_like(line: Column, language: Column, table: dict[str, list[str]]) -> Column:
    """Whether a stripped line matches one of its language's patterns."""
    out = F.lit(False)
    for name, patterns in table.items():
        out = F.when(language == name, reduce(lambda a, b: a | b, (line.rlike(p) for p in patterns))).otherwise(out)
    return out


def is_comment(line: Column, language: Column) -> Column:
    """Whether a stripped line is blank or begins like a comment."""
    begins = lambda marks: reduce(lambda a, b: a | b, (line.startswith(m) for m in marks))
    return (line == "") | F.when(language == "python", begins(COMMENTS["python"])).when(language == "unknown", begins(COMMENTS["unknown"])).otherwise(begins(SLASHES))


def changed_names(line: Column) -> Column:
    """Names that a changed line declares, and the first that it calls."""
    found = [F.regexp_extract(line, rf"\b{w}\s+([A-Za-z_][A-Za-z0-9_]*)", 1) for w in DECLARING] + [F.regexp_extract(line, r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x != ""))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diffs (…, text) as (…, file_no, path, added, line): the changed lines, other columns kept.

    The path of a file is what its `+++` line names, else the second path of its
    `diff --git` line. Lines that begin like a header are none, as `---` and `+++`
    always do. A diff is cut at its `diff --git` lines inside its row, so no line is shuffled.
    Arrays are exploded with their empty rows, as else the optimizer makes them twice, to drop those.
    """
    keep = [c for c in diffs.columns if c != "text"]
    rest = lambda x, n: F.trim(F.substring(x, n, 1 << 20))
    at = diffs.select(*keep, lines(F.col("text")).alias("_ls")).withColumn("_at", F.filter(F.transform("_ls", lambda x, i: F.when(F.startswith(x, F.lit("diff --git ")), i + 1)), lambda i: i.isNotNull()))
    cut = at.select("*", F.posexplode_outer("_at").alias("_k", "_b")).filter("_b IS NOT NULL")
    files = cut.select(*keep, (F.col("_k") + 1).cast("long").alias("file_no"), F.slice("_ls", F.col("_b"), F.coalesce(F.try_element_at("_at", F.col("_k") + 2), F.size("_ls") + 1) - F.col("_b")).alias("_f"))
    named = F.array_max(F.transform(F.filter("_f", lambda x: F.startswith(x, F.lit("+++ ")) & (rest(x, 5) != "/dev/null")), lambda x: F.regexp_replace(rest(x, 5), "^b/", "")))
    git = F.regexp_replace(F.regexp_extract(F.element_at("_f", 1), r"^diff --git \S+ (\S+)", 1), "^b/", "")
    each = files.select(*keep, "file_no", "_f", F.coalesce(named, git).alias("path")).select(*keep, "file_no", "path", F.explode_outer("_f").alias("_l"))
    added, removed = F.col("_l").startswith("+") & ~F.col("_l").startswith("+++"), F.col("_l").startswith("-") & ~F.col("_l").startswith("---")
    return each.filter(added | removed).select(*keep, "file_no", "path", added.alias("added"), F.substring("_l", 2, 1 << 20).alias("line"))


def line_facts(changed: DataFrame) -> DataFrame:
    """changed (…, path, line) with language, signature, dependency and comment of each line."""
    known = changed.withColumns({"language": language_of(F.col("path")), "_s": stripped(F.col("line"))})
    s, language = F.col("_s"), F.col("language")
    return known.withColumns({"signature": looks_like(s, language, SIGNATURES), "dependency": looks_like(s, language, DEPENDENCIES), "comment": is_comment(s, language)}).drop("_s")


def file_changes(changed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: added, removed, signatures, dependencies, comment_only, change_kind and section."""
    g = line_facts(changed).groupBy(*keys).agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("removed"), F.count_if("signature").alias("signatures"),
                                              F.count_if("dependency").alias("dependencies"), F.bool_and("comment").alias("comment_only"))
    kind = F.when(F.col("signatures") > 0, "interface_change").when(F.col("dependencies") > 0, "dependency_change").when(F.col("comment_only"), "documentation_only").when(
        F.col("added") + F.col("removed") > 0, "logic_change").otherwise("unknown")
    section = reduce(lambda acc, kv: F.when(F.col("change_kind") == kv[0], kv[1]).otherwise(acc), SECTIONS.items(), F.lit("Detailed Design"))
    return g.withColumn("change_kind", kind).withColumn("section", section)
