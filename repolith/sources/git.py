"""Commits, trees and diffs of git repositories as Spark data sources.

    register(spark)
    spark.read.format("git_log").option("repo", path).option("target", "HEAD").load()

Formats: git_log, git_tree, git_diff. Git runs on the executors, in a folder that
they can all read; a tree is read in parts of its path list, and a diff per commit.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


class GitError(RuntimeError):
    """What git said when a command failed."""


def git(repo: str, *args: str) -> str:
    """Output of a git command in a repository."""
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def resolve(repo: str, rev: str) -> str:
    """The commit that a revision names."""
    return git(repo, "rev-parse", "--verify", f"{rev}^{{commit}}").strip()


def is_strict_ancestor(repo: str, ancestor: str, descendant: str) -> bool:
    """Whether one commit comes before another one on some line of parents."""
    a, b = resolve(repo, ancestor), resolve(repo, descendant)
    return a != b and subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "merge-base", "--is-ancestor", a, b], capture_output=True).returncode == 0


class Part(InputPartition):
    """What one task reads."""

    def __init__(self, items: list[str]) -> None:
        self.items = items


class _Source(DataSource):
    def reader(self, schema):  # noqa: ANN001, ANN201
        return self.READER(dict(self.options))


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = options

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001
        o = self.o
        span = f"{o['previous']}..{o.get('target', 'HEAD')}" if o.get("previous") else o.get("target", "HEAD")
        flags = ["--first-parent"] if o.get("firstparent", o.get("firstParent", "false")).lower() == "true" else ["--ancestry-path"] * bool(o.get("previous"))
        text = git(o["repo"], "log", "--reverse", "--topo-order", *flags, "--format=%H%x1f%h%x1f%cI%x1f%P%x1f%s%x1e", span)
        for i, row in enumerate(filter(None, (x.strip("\n") for x in text.split("\x1e")))):
            sha, short, when, parents, subject = row.split("\x1f")
            yield i, sha, short, when, parents.split(), subject


class GitLog(_Source):
    """Commits of an interval, oldest first: seq, sha, short_sha, timestamp (ISO 8601), parents, subject. Options: repo, target, previous, firstParent."""

    READER = _LogReader

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "seq int, sha string, short_sha string, timestamp string, parents array<string>, subject string"


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = options

    def partitions(self) -> list[Part]:
        o = self.o
        paths = git(o["repo"], "ls-tree", "-r", "-z", "--name-only", resolve(o["repo"], o.get("rev", "HEAD")), *([o["prefix"]] if o.get("prefix") else [])).split("\0")
        paths, size = [p for p in paths if p], int(o.get("files", 500))
        return [Part(paths[i : i + size]) for i in range(0, len(paths), size)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        sha = resolve(self.o["repo"], self.o.get("rev", "HEAD"))
        for path in partition.items:
            yield sha, path, git(self.o["repo"], "show", f"{sha}:{path}")


class GitTree(_Source):
    """Files of a commit: sha, path, text. Options: repo, rev, prefix, files (paths of a task)."""

    READER = _TreeReader

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "sha string, path string, text string"


class _DiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = options

    def partitions(self) -> list[Part]:
        o = self.o
        if o.get("base"):
            return [Part([resolve(o["repo"], o.get("target", "HEAD"))])]
        span = f"{o['previous']}..{o.get('target', 'HEAD')}" if o.get("previous") else o.get("target", "HEAD")
        return [Part([x]) for x in git(o["repo"], "rev-list", "--reverse", span).split()] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for sha in partition.items:
            if self.o.get("base"):
                base = resolve(self.o["repo"], self.o["base"])
                yield sha, base, git(self.o["repo"], "diff", "--unified=0", base, sha)
                continue
            parents = git(self.o["repo"], "rev-list", "--parents", "-n", "1", sha).split()[1:]
            yield sha, parents[0] if parents else None, git(self.o["repo"], "diff", "--unified=0", parents[0] if parents else EMPTY_TREE, sha)


class GitDiff(_Source):
    """Diff of each commit to its first parent, or to nothing: diff_id (sha), base, text. Options: repo, target, previous; with base, the one diff from base to target."""

    READER = _DiffReader

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "diff_id string, base string, text string"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (GitLog, GitTree, GitDiff):
        spark.dataSource.register(source)


def tags_by_commit(log: DataFrame, tags: DataFrame) -> DataFrame:
    """(sha, tags): tags (tag, sha) of the commits of a log, in order."""
    return log.select("sha").join(tags, "sha").groupBy("sha").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def ancestors(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(sha, ancestor) of the asked commits (sha) of a repository's log, which lists parents before their children by seq.

    One walk from the newest commit down: each commit hands the set of asked commits
    above it to its parents. A log is one task's stream, as git writes it; in memory
    are only commits that a child has named and that are not met yet. What comes out is as long as the
    asked commits' histories, never a closure of all pairs.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[str, int] = {}
        names: list[str] = []
        for b in batches:
            out = []
            for sha, parents, wanted in zip(b["sha"], b["parents"], b["wanted"], strict=True):
                told = above.pop(sha, 0)
                out += [(names[k], sha) for k in range(told.bit_length()) if told >> k & 1]
                if wanted:
                    told |= 1 << len(names)
                    names.append(sha)
                if told:
                    for p in parents:
                        above[p] = above.get(p, 0) | told
            yield pd.DataFrame(out, columns=["sha", "ancestor"])

    told = log.select("seq", "sha", "parents").join(asked.select("sha").distinct().withColumn("wanted", F.lit(True)), "sha", "left").fillna(False, ["wanted"])
    return told.coalesce(1).sortWithinPartitions(F.desc("seq")).select("sha", "parents", "wanted").mapInPandas(walk, "sha string, ancestor string")


def previous_benchmark(log: DataFrame, tags: DataFrame) -> DataFrame:
    """(sha, rule) of the commit to compare a first-parent log's last one with: the newest before it that has a tag, else the newest merge, else the twentieth before it or the first. An empty row set where there is none before."""
    last = log.agg(F.max("seq").alias("last"))
    before = log.join(last, F.col("seq") < F.col("last")).join(tags.select("sha").distinct().withColumn("tagged", F.lit(True)), "sha", "left")
    back = F.col("last") - F.col("seq")
    return before.agg(F.max_by("sha", F.when(F.col("tagged"), F.col("seq"))).alias("t"), F.max_by("sha", F.when(F.size("parents") > 1, F.col("seq"))).alias("m"), F.max_by("sha", F.when(back <= 20, back)).alias("b")).select(
        F.coalesce("t", "m", "b").alias("sha"), F.when(F.col("t").isNotNull(), "tag").when(F.col("m").isNotNull(), "merge").otherwise("distance").alias("rule")).filter("sha IS NOT NULL")
