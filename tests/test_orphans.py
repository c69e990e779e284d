from __future__ import annotations

from datetime import datetime

from conftest import rows

from repolith.functions.paths import normal_path, suffix
from repolith.operators import orphans as O

NODES = "csc_id string, node_id string, path string, recorded_at timestamp, removed_at timestamp, kind string, node string"
EDGES = "csc_id string, edge_id string, source_id string, target_id string, recorded_at timestamp, ref_id string, at string"
DEPS = "csc_id string, dependency_id string, resolution_status string, target_path string, recorded_at timestamp, depth int"


def t(day: int) -> datetime:
    return datetime(2024, 2, day)


def tables(spark, nodes, edges, deps):
    return (spark.createDataFrame([(*x, "k", "n") for x in nodes], NODES), spark.createDataFrame([(*x, "r", "a") for x in edges], EDGES), spark.createDataFrame([(*x, 1) for x in deps], DEPS))


def test_direct_and_inherited(spark):
    nodes = [("r", "dir::a", "a", t(1), None), ("r", "file::a/x.py", "a/x.py", t(2), t(10)), ("r", "file::a/x.py", "a/x.py", t(2), t(10)), ("r", "file::a/x.py", "a/x.py", t(15), None),
             ("r", "sym::a/x.py::f", "a/x.py", t(3), None), ("r", "file::b/c/y.py", "b/c/y.py", t(2), None), ("r", "sym::b/c/y.py::g", "b/c/y.py", t(3), None), ("r", "commit::1", None, t(1), None), ("q", "file::b.py", "b.py", None, None)]
    edges = [("r", "ok", "file::./a//x.py", "sym::a/x.py::f", t(5)), ("r", "removed", "file::a/x.py", "commit::1", t(10)), ("r", "again", "file::a\\x.py", "commit::1", t(15)), ("r", "late", "commit::1", "sym::a/x.py::f", t(2)),
             ("r", "null", None, "commit::1", t(5)), ("r", "heir", "commit::1", "sym::b/c/y.py::g", t(9)), ("r", "heir", "commit::1", "sym::b/c/y.py::g", t(9)), (None, "lost", "commit::1", None, t(9)), ("r", "timeless", "commit::1", None, None), ("r", "case", "file::A/x.py", None, t(5))]
    deps = [("r", "d1", " Resolved_Exact ", "a/./x.py", t(4)), ("r", "d2", "resolved_heuristic", None, t(4)), ("r", "d3", "unresolved", None, t(4)), ("r", "d4", "RESOLVED_EXACT", "nowhere.py", t(4)), ("r", "d5", "resolved_exact", "b/c/y.py", t(4)), ("q", "d6", "resolved_exact", "a/x.py", t(4)), ("r", "d7", None, "x", t(4))]
    got = O.orphan_cascade(*tables(spark, nodes, edges, deps))
    assert rows(got.filter("ref_table <> 'graph_nodes'"), "record_key", "ref_field", "kind", "depth") == sorted([
        ("removed", "source_id", "direct", 0), ("late", "target_id", "direct", 0), ("lost", "source_id", "direct", 0), ("timeless", "source_id", "direct", 0), ("case", "source_id", "direct", 0),
        ("d2", "target_path", "direct", 0), ("d4", "target_path", "direct", 0), ("d6", "target_path", "direct", 0), ("heir", "target_id", "inherited", 2), ("d5", "target_path", "inherited", 1)], key=str)
    assert rows(got.filter("ref_table = 'graph_nodes'"), "record_key", "kind", "depth") == [("file::b/c/y.py", "direct", 0), ("sym::b/c/y.py::g", "inherited", 1)]
    report = O.orphan_report(got)
    assert rows(report.filter("month IS NULL"), "ref_table", "orphans") == [("graph_edges", 1)]


def test_empty_tables(spark):
    assert O.orphan_cascade(*tables(spark, [], [], [])).count() == 0
    assert O.orphan_cascade(*tables(spark, [], [("r", "e", "x", "y", t(1))], [])).count() == 2


def test_paths(spark):
    p = spark.createDataFrame([("a//b/./c",), ("\\a\\b",), ("./x.Py",), ("a/.gitignore",), ("",), (None,), ("a/b.tar.GZ",), ("..",)], "p string")
    got = [tuple(r) for r in p.select(normal_path(p.p), suffix(p.p)).collect()]
    assert got == [("a/b/c", ""), ("a/b", ""), ("x.Py", ".py"), ("a/.gitignore", ""), ("", ""), (None, None), ("a/b.tar.GZ", ".gz"), ("..", "")]
