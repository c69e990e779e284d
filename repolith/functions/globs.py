"""Right-anchored path patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The regular expression of a pattern: matched from the right unless it begins with `/`, `*` and `?` within a segment, `**` as exactly one segment."""
    out = []
    for segment in pattern.strip("/").split("/"):
        if segment == "**":
            out.append("[^/]+")
            continue
        text = re.sub(r"(\*+)|(\?)|(\[!?[^\]]+\])|(.)", lambda m: "[^/]*" if m[1] else "[^/]" if m[2] else m[3].replace("[!", "[^") if m[3] else re.escape(m[4]), segment)
        out.append(text)
    return ("^" if pattern.startswith("/") else "(^|/)") + "/".join(out) + "$"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the patterns; no pattern matches nothing."""
    return reduce(lambda a, b: a | b, (path.rlike(glob_regex(p)) for p in patterns), F.lit(False))


def ignore_regex(pattern: str) -> str | None:
    """The regular expression of a line of an ignore file, null for comments and blanks; the mark of an exception is not part of it.

    `/` inside or at the front anchors a pattern, `/` at the end asks for a folder,
    `**` stands for any folders; what lies in an ignored folder is ignored.
    """
    text = pattern.rstrip("\n").rstrip(" ")
    text = text[1:] if text.startswith("!") else text
    if not text or text.startswith("#"):
        return None
    folder, text = text.endswith("/"), text.strip("/") if text.endswith("/") else text
    anchored = "/" in text
    out = re.sub(r"(\*\*/)|(/\*\*$)|(\*+)|(\?)|(\[!?[^\]]+\])|(.)", lambda m: "(?:[^/]+/)*" if m[1] else "/.+" if m[2] else "[^/]*" if m[3] else "[^/]" if m[4] else m[5].replace("[!", "[^") if m[5] else re.escape(m[6]), text.lstrip("/"))
    return ("^" if anchored or pattern.lstrip("!").startswith("/") else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the lines of an ignore file leave a path out: the last line that matches decides, `!` takes a path in again."""
    out = F.lit(False)
    for line in patterns:
        if (regex := ignore_regex(line)) is not None:
            out = F.when(path.rlike(regex), not line.startswith("!")).otherwise(out)
    return out
