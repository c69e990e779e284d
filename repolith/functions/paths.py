"""Column functions on repository paths and node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE = "file::"


def normal_path(path: Column) -> Column:
    """`/` as separator, without empty and `.` segments; letter case stays. Null stays null."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    odd = path.rlike(r"\\|(^|/)\.?(/|$)")
    return F.when(odd, F.array_join(parts, "/")).otherwise(path)


def normal_node_id(node_id: Column) -> Column:
    """Node id whose path after `file::` is written in the normal form."""
    return F.when(node_id.startswith(FILE), F.concat(F.lit(FILE), normal_path(F.substring(node_id, len(FILE) + 1, 1 << 30)))).otherwise(node_id)


def parent_dir(path: Column) -> Column:
    """Directory of a normal path; null for a path of one segment."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, empty where there is none; a leading dot of the name is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))
