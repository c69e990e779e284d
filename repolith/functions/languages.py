"""Language of a file by its suffix."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolith.functions.paths import suffix

# Suffix and language.
SUFFIXES = {
    ".py": "python", ".java": "java", ".c": "cpp", ".cc": "cpp", ".cpp": "cpp", ".h": "cpp", ".hpp": "cpp", ".js": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".cs": "csharp",
}


def language_of(path: Column) -> Column:
    """Language of a path by its lower-cased suffix, `unknown` for any other; null for null."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(SUFFIXES.items())))
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(table, suffix(path)), F.lit("unknown")))
