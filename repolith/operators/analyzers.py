"""Symbols and imports of source texts by language, by patterns over text without comments and literals."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.session import spread

# What declares a class, a function and an import in each language; the name, or the import, is the first group.
CLASSES = {
    "python": r"(?m)^[ \t]*class\s+(\w+)", "java": r"(?m)^[ \t]*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)", "cpp": r"(?m)^[ \t]*(?:class|struct)\s+(\w+)\s*(?:final\s*)?(?::[^;{]*)?\{",
    "javascript": r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?class\s+(\w+)", "typescript": r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)", "go": r"(?m)^type\s+(\w+)\s+(?:struct|interface)\b",
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", "csharp": r"(?m)^[ \t]*(?:(?:public|protected|private|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|enum|record)\s+(\w+)",
}
FUNCTIONS = {
    "python": r"(?m)^[ \t]*(?:async\s+)?def\s+(\w+)", "java": r"(?m)^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|native)\s+)*(?!(?:return|new|else|throw)\b)[A-Za-z_][\w<>,.\[\]]*\s+(\w+)\s*\([^;{}()]*\)\s*(?:throws\s+[\w., ]+)?\{",
    "cpp": r"(?m)^[ \t]*(?!(?:return|else|new|case|if|for|while|switch)\b)(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(?:\w+::)?(~?\w+)\s*\([^;{}()]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{",
    "javascript": r"(?m)^[ \t]*(?:(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*|(?:static\s+)?(?:async\s+)?(?!(?:if|for|while|switch|catch|function|return)\b)(?=\w+\s*\([^;{}()]*\)\s*\{))(\w+)\s*\([^;{}]*\)\s*\{",
    "typescript": r"(?m)^[ \t]*(?:(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+|(?:(?:public|private|protected|static|async)\s+)*(?!(?:if|for|while|switch|catch|function|return)\b)(?=\w+\s*\([^;{}]*\)\s*(?::[^;{]*)?\{))(\w+)\s*\([^;{}]*\)\s*(?::[^;{]*)?\{",
    "go": r"(?m)^func\s*(?:\([^)]*\)\s*)?(\w+)\s*\(", "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)",
    "csharp": r"(?m)^[ \t]*(?:(?:public|protected|private|internal|static|virtual|override|sealed|abstract|async)\s+)+(?!(?:class|new|return)\b)[A-Za-z_][\w<>,.\[\]?]*\s+(\w+)\s*\([^;{}()]*\)\s*\{",
}
IMPORTS = {
    "python": r"(?m)^[ \t]*((?:from\s+\S+\s+import\s+[^\n#]+|import\s+[^\n#]+))", "java": r"(?m)^[ \t]*((?:import|package)\s+[\w.* ]+\s*;)", "cpp": r"(?m)^[ \t]*(#\s*include\s*[<\"][^>\"\n]+[>\"])",
    "javascript": r"(?m)^[ \t]*(import\s+[^\n]+)", "typescript": r"(?m)^[ \t]*((?:import|export)\s+[^\n]*\bfrom\b[^\n]+)", "go": r"(?m)^(import\s+(?:\w+\s+)?\"[^\"\n]+\")", "rust": r"(?m)^[ \t]*((?:pub\s+)?use\s+[^;]+;)", "csharp": r"(?m)^[ \t]*((?:global\s+)?using\s+[\w.]+\s*;)",
}
_BLOCK = r"(?s)/\*.*?\*/|(?m://[^\n]*$)"


def _bare(text: Column, language: Column) -> Column:
    """Text in which comments, and triple-quoted texts of Python, are blanks."""
    return F.when(language == "python", F.regexp_replace(text, r"(?s)\"\"\".*?\"\"\"|'''.*?'''", " ")).otherwise(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "))


def _all(text: Column, language: Column, table: dict[str, str]) -> Column:
    out = F.array().cast("array<string>")
    for name, pattern in table.items():
        out = F.when(language == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(out)
    return F.array_distinct(F.transform(out, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))


def summaries(files: DataFrame) -> DataFrame:
    """(csc_id, path, language, functions, classes, imports) of files (csc_id, path, text), in order of first mention, each once.

    Texts are read whole, inside the engine's own expressions. Null texts, and
    languages unknown by suffix, have empty lists.
    """
    language = language_of(F.col("path"))
    bare = _bare(F.coalesce("text", F.lit("")), language)
    f = files.select("csc_id", "path", language.alias("language"), bare.alias("bare"))
    return f.select("csc_id", "path", "language", _all(F.col("bare"), F.col("language"), FUNCTIONS).alias("functions"), _all(F.col("bare"), F.col("language"), CLASSES).alias("classes"), _all(F.col("bare"), F.col("language"), IMPORTS).alias("imports"))


Symbol = tuple[str, str, str, str | None, int, int]  # kind, name, qualified name, owner, first and last line

_QUOTES = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_HIDDEN = {k: re.compile(rf"/\*[\s\S]*?\*/|//[^\n]*|{extra}{_QUOTES}") for k, extra in {
    "java": r'"""[\s\S]*?"""|', "cpp": "", "javascript": r"`(?:[^`\\]|\\[\s\S])*`|", "typescript": r"`(?:[^`\\]|\\[\s\S])*`|", "go": r"`[^`]*`|", "rust": r"'[a-z_]+\b(?!')|", "csharp": r'@"(?:[^"]|"")*"|'}.items()}
_CLASS = {k: re.compile(v) for k, v in CLASSES.items()}
_FUNCTION = {k: re.compile(v) for k, v in FUNCTIONS.items()}
#: Blocks that own what they hold without declaring it, and functions that name their owner.
_IMPL = re.compile(r"(?m)^[ \t]*impl\b(?:\s*<[^>{]*>)?\s+(?:[\w:]+(?:<[^{]*>)?\s+for\s+)?(?:\w+::)*(\w+)")
_KIND = re.compile(r"\b(class|interface|struct|enum|record|trait)\b")
_RECEIVER = re.compile(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)")
_OF_CLASS = re.compile(r"(\w+)\s*::\s*~?\w+\s*\(")


def _hidden(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _python_symbols(text: str) -> list[Symbol] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[Symbol] = []
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{owner}.{child.name}" if owner else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append((kind, child.name, inner, owner, child.lineno, child.end_lineno))
            stack.append((child, inner))
    return out


def _indented_symbols(text: str) -> list[Symbol]:
    """Symbols of Python that does not parse: a block ends before the next line that is indented no deeper."""
    rows = text.split("\n")
    out, open_ = [], []
    for n, row in enumerate(rows, 1):
        if not row.strip():
            continue
        depth = len(row) - len(row.lstrip())
        open_ = [x for x in open_ if x[0] < depth]
        if m := re.match(r"\s*(?:(class)|(?:async\s+)?def)\s+(\w+)", row):
            owner = open_[-1][1] if open_ else None
            qualified = f"{owner}.{m[2]}" if owner else m[2]
            end = n
            for k in range(n, len(rows)):
                if rows[k].strip():
                    if len(rows[k]) - len(rows[k].lstrip()) <= depth:
                        break
                    end = k + 1
            out.append(("class" if m[1] else "method" if open_ and open_[-1][2] else "function", m[2], qualified, owner, n, end))
            open_.append((depth, qualified, bool(m[1])))
    return out


def _braced_symbols(text: str, language: str) -> list[Symbol]:
    """Declarations found by pattern in text whose comments and literals are blank; a block's owner is the innermost declaration around it."""
    code = _HIDDEN[language].sub(_hidden, text)
    begins = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(begins, at)
    closes, open_ = {}, []
    for m in re.finditer("[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            closes[open_.pop()] = m.start()
    found = [("class", m) for m in _CLASS[language].finditer(code)] + [("function", m) for m in _FUNCTION[language].finditer(code)]
    if language == "rust":
        found += [("impl", m) for m in _IMPL.finditer(code)]
    scopes: list[tuple[int, int, str]] = []  # body begin, end, qualified name
    out: list[Symbol] = []
    for kind, m in sorted(found, key=lambda x: (x[1].start(1), x[0])):
        at = m.start(1)
        brace, stop = code.find("{", m.start(1)), code.find(";", m.start(1))
        body = brace if brace >= 0 and (stop < 0 or brace < stop) and brace in closes else -1
        owner = next((q for a, z, q in reversed(scopes) if a < at < z), None)
        if language == "go" and kind == "function" and (r := _RECEIVER.match(code[m.start() : at])):
            owner = r[1]
        if language == "cpp" and kind == "function" and (r := _OF_CLASS.search(code[m.start() : code.find("(", at) + 1])):
            owner = owner or r[1]
        name = m[1]
        qualified = name if kind == "impl" else f"{owner}.{name}" if owner else name
        if body >= 0:
            scopes.append((body, closes[body], qualified))
        if kind == "class":
            kind = _KIND.search(m[0])[1]
        elif kind == "function" and owner:
            kind = "method"
        out.append((kind, name, qualified, None if kind == "impl" else owner, line(at), line(closes[body]) if body >= 0 else line(at)))
    return out


def file_symbols(path: str, language: str, text: str) -> list[Symbol]:
    """Symbols of a whole text with their spans, each (kind, qualified name) once, and a module symbol where there is any class or function. A suffix of no known language has none."""
    text = text.replace("\r\n", "\n")
    if language == "python":
        found = _python_symbols(text.removeprefix("\ufeff"))
        found = _indented_symbols(text) if found is None else found
    elif language in _HIDDEN:
        found = _braced_symbols(text, language)
    else:
        found = []
    out, seen = [], set()
    for s in sorted(found, key=lambda x: (x[4], x[5], x[2])):
        if (s[0], s[2]) not in seen:
            seen.add((s[0], s[2]))
            out.append(s)
    if out:
        stem = re.sub(r"(.)\.[^.]*$", r"\1", path.rsplit("/", 1)[-1])
        out.append(("module", stem, stem, None, 1, max(1, text.count("\n") + (not text.endswith("\n")))))
    return out


def _analyze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(c, p, lang, *s) for c, p, lang, t in zip(b["csc_id"], b["path"], b["language"], b["text"], strict=True) for s in file_symbols(p, lang, t)]
        yield pd.DataFrame(rows, columns=["csc_id", "path", "language", "kind", "name", "qualified_name", "owner", "line_start", "line_end"]).astype({"line_start": "Int32", "line_end": "Int32"})


def symbols(files: DataFrame) -> DataFrame:
    """(csc_id, path, language, kind, name, qualified_name, owner, line_start, line_end) of files (csc_id, path, text): nested symbols with their spans.

    Python is read by the interpreter's parser, or by indentation where it does not
    parse; other languages by declarations and braces. Null paths and texts have none; repeated files count once.
    """
    texts = files.select("csc_id", "path", "text").filter("path IS NOT NULL AND text IS NOT NULL").withColumn("language", language_of(F.col("path"))).filter("language <> 'unknown'")
    return spread(texts, "csc_id", "path").mapInPandas(_analyze, "csc_id string, path string, language string, kind string, name string, qualified_name string, owner string, line_start int, line_end int").distinct()
