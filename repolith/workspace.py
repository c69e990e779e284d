"""Places and settings of a workspace: its folders, a store found from any path into it, a validated configuration, JSON artifacts and run times."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Folders of a workspace: shared artifacts, and a folder for each tool."""

    root: str
    workspace_id: str

    @property
    def shared(self) -> str:
        return f"{self.root.rstrip('/')}/workspaces/{self.workspace_id}/shared"

    def tool(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/workspaces/{self.workspace_id}/tools/{name}"


def store_root(path: str) -> str:
    """The folder of a store, given the folder, its manifest or a table in it."""
    p = path.rstrip("/")
    return p.rpartition("/")[0] if p.rpartition("/")[2] in ("manifest", "chunks", "postings", "nodes", "edges") else p


@dataclass(frozen=True)
class Config:
    """Settings of a project; other names and wrong types are errors."""

    sources: list[str] = field(default_factory=lambda: ["."])
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    chunk_lines: int = 40
    top_k: int = 6
    graph_top_k: int = 12
    graph_depth: int = 1
    chunk_tokens: int = 8192


def load_config(path: str) -> Config:
    """Configuration from a JSON or YAML file; source folders are taken from the file's own folder."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text) or {}
    known = {f.name: f for f in fields(Config)}
    if not isinstance(given, dict) or given.keys() - known.keys():
        raise ValueError(f"unknown settings: {sorted(given.keys() - known.keys()) if isinstance(given, dict) else given!r}")
    config = Config(**given)
    for name in known:
        want = int if isinstance(getattr(Config(), name), int) else list
        if not isinstance(getattr(config, name), want):
            raise ValueError(f"{name} must be {want.__name__}")
    here = Path(path).resolve().parent
    return Config(**{**given, "sources": [str((here / s).resolve()) for s in config.sources]})


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row, columns in alphabetical order, for export."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


@contextmanager
def timed(metrics: list[dict], stage: str) -> Iterator[None]:
    """Adds the wall time of a block, which must end in an action, to metrics."""
    began = time.time()
    try:
        yield
    finally:
        metrics.append({"stage": stage, "elapsed_seconds": round(time.time() - began, 3)})
