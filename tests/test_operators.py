from __future__ import annotations

import subprocess

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repolith.functions import text as X
from repolith.functions.globs import glob_regex
from repolith.operators import changes, generation, history, imports, manifests, rendering, repository, retrieval
from repolith.sources import git, stores
from repolith.streaming import events as stream


def test_text_functions(spark):
    df = spark.createDataFrame([("Ünïté foo_1 FOO_1\r\nb\x0bc\n",), ("",), (None,), ("\n\n",)], "t string")
    assert [r[0] for r in df.select(X.tokens(df.t)).collect()] == [["n", "t", "foo_1", "foo_1", "b", "c"], [], [], []]
    assert [r[0] for r in df.select(X.keywords(df.t, 2)).collect()][0] == ["n", "t"]
    assert [r[0] for r in df.select(X.lines(df.t)).collect()] == [["Ünïté foo_1 FOO_1", "b", "c"], [], [], ["", ""]]
    long = spark.createDataFrame([("x" * 500,), ("  a\nb ",)], "t string")
    assert [r[0] for r in long.select(X.quote(long.t, 40)).collect()] == ["x" * 40 + "...", "a b"]
    assert spark.range(1).select(X.bucket(F.lit("route"))).first()[0] == 46


@pytest.mark.parametrize(("pattern", "path", "hit"), [("**/*.py", "a.py", False), ("**/tests/**", "tests/a.py", False), ("**/tests/**", "x/tests/a.py", True), ("**/tests/**", "x/tests/y/a.py", False), ("*.py", "x/a.py", True), ("a?c.[ch]", "abc.h", True)])
def test_globs(pattern, path, hit):
    import re

    assert bool(re.search(glob_regex(pattern), path)) == hit


CHUNKS = "csc_id string, chunk_id string, source_type string, source_path string, text string, section_id string, line_start int, line_end int, rank int, score double"


def chunks(spark, *texts):
    return retrieval.chunk_rows(spark.createDataFrame([("r", c, "code", p, t, None, n, None, 1, 0.5) for c, p, t, n in texts], CHUNKS))


def test_ranking_and_fallback(spark):
    c = chunks(spark, ("a", "doc.md", "route planning engine", None), ("b", "doc.md", "storage engine", None), ("b", "doc.md", "storage engine", None), ("c", "a.py", None, 4), ("d", "a.py", "", 1))
    q = spark.createDataFrame([("r", "1", "Route planning route"), ("r", "2", "nothing here"), ("x", "3", "route"), ("r", "4", None)], "csc_id string, question_id string, question string")
    assert rows(retrieval.top_k(c, q, 1), "question_id", "rank", "chunk_id") == [("1", 1, "a"), ("2", 1, "d"), ("4", 1, "d")]
    twice = {r["question_id"]: r["score"] for r in retrieval.bm25(c, spark.createDataFrame([("r", "once", "planning"), ("r", "twice", "planning planning")], q.schema)).collect()}
    assert twice["twice"] == pytest.approx(2 * twice["once"], abs=1e-8)
    assert retrieval.top_k(c.limit(0), q, 3).count() == 0


def test_ranking_in_cells_is_that_of_the_sql(spark):
    import duckdb

    from repolith.plans.retrieval import SQL

    told = "csc_id string, chunk_id string, source_type string, source_path string, text string, section_id string, line_start int, line_end int"
    words = ["route", "plan", "store", "key", "engine", "x_1", "Ünï", "42"]
    rows_ = [(f"csc{i % 2}", f"c{i:02}", "code", f"p{i % 5}.py", " ".join(words[j % 8] for j in range(i % 7, i)), None, i % 3, i) for i in range(40)]
    rows_ += [("csc0", "c10", "code", "p0.py", f"route {w}", None, 1, 10) for w in ("plan", "key", "store", "engine")]  # of equal columns but for the text, the first text stays
    rows_ += [rows_[8], ("csc0", None, "code", "a.py", "route route plan", None, 0, 1), (None, "n", "code", "a.py", "route", None, 0, 1), ("csc2", "e", "code", "b.py", None, None, None, 1), ("csc2", "f", "code", "a.py", "", None, 4, 1)]
    asked = [(f"ws{i % 3}", f"q{i}", t) for i, t in enumerate(["Route plan ROUTE", "key 42", "route", "nothing", "engine x_1 store", "", "plan", "x_1", "none"])] + [("ws0", None, "store key"), ("ws9", "q", "route"), ("ws1", "null", None)]
    c, q = spark.createDataFrame(rows_, told), spark.createDataFrame([("csc" + w[2:], i, t) for w, i, t in asked if t is not None], "csc_id string, question_id string, question string")
    duck = duckdb.connect()
    duck.register("knowledge_chunks", c.toArrow())
    duck.register("history_checkpoints", spark.createDataFrame(asked, "workspace_id string, checkpoint_id string, target_commit_subject string").toArrow())
    best = sorted(duck.sql(SQL["ref_t01_top_k"]).select("csc_id, question_id, rank, chunk_id, score").fetchall(), key=str)
    assert len({r[:2] for r in best}) == 10 and any(r[4] == 0 for r in best) and any(r[4] > 0 for r in best)
    for most in (1, 3, 4096):
        assert [(*r[:4], pytest.approx(r[4], abs=1e-8)) for r in rows(retrieval.top_k(c, q, 6, most), "csc_id", "question_id", "rank", "chunk_id", "score")] == best, most


def test_ranking_never_shuffles_the_terms_of_chunks(spark):
    words = " ".join(f"w{i}" for i in range(80))
    c = spark.createDataFrame([("r", f"c{i}", "code", "a.py", words, None, i, None, 1, 0.5) for i in range(500)], CHUNKS)
    q = spark.createDataFrame([("r", str(i), words) for i in range(10)], "csc_id string, question_id string, question string")
    context = spark.sparkContext

    def written() -> int:
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert retrieval.top_k(c, q, 3).count() == 30
    assert written() - before < 500 * 80 / 2  # a row for each chunk and term would be 40,000


def test_rerank_score(spark):
    c = chunks(spark, ("a", "a.py", "x", 1), ("b", "b.py", "x", 1))
    q = spark.createDataFrame([("r", "1", "how does it work")], "csc_id string, question_id string, question string")
    lexical = spark.createDataFrame([("r", "1", "a", 2.0), ("r", "1", "b", 4.0)], "csc_id string, question_id string, chunk_id string, score double")
    graph = spark.createDataFrame([("r", "1", "a", 0.5)], "csc_id string, question_id string, chunk_id string, graph_score double")
    anchors = spark.createDataFrame([("r", "1", "a.py")], "csc_id string, question_id string, source_path string")
    assert rows(retrieval.rerank(lexical, graph, c, q, anchors), "chunk_id", "final_score", "rank") == [("a", 0.67, 2), ("b", 0.72, 1)]


def test_intents(spark):
    q = spark.createDataFrame([("what is the impact on modules",), ("which modules import it",), ("design overview",), ("",), (None,)], "q string")
    assert [r[0] for r in q.select(retrieval.intent(q.q)).collect()] == ["change_impact", "dependency", "architecture", "implementation", "implementation"]


def test_expand(spark):
    e = spark.createDataFrame([("r", f"e{i}", "t", s, t) for i, (s, t) in enumerate([("a", "b"), ("c", "b"), ("b", "d"), ("d", "e"), ("a", "a"), ("a", None)])], "csc_id string, edge_id string, edge_type string, source_id string, target_id string")
    a = spark.createDataFrame([("r", "a"), ("r", "a"), ("x", "a")], "csc_id string, anchor string")
    assert rows(repository.expand(a, e, 5), "node_id", "distance", "via") == [("b", 1, "a"), ("c", 2, "b"), ("d", 2, "b")]
    assert rows(repository.expand(a, e, 2, 1), "node_id") == [("b",)]


def test_expand_around_hubs(spark):
    import random

    r = random.Random(2)
    edges = [("r", f"e{i:04d}", "t", f"n{r.randrange(40) if r.random() < 0.6 else 0}", f"n{r.randrange(40)}") for i in range(400)]
    near: dict = {}
    for _, e, _, a, b in edges:
        near.setdefault(a, []).append((e, b))
        near.setdefault(b, []).append((e, a))
    want = []
    for anchor in (f"n{i}" for i in range(40)):
        seen, frontier, hits = {anchor}, [anchor], []
        for step in (1, 2):
            found: dict = {}
            for via in frontier:
                for e, x in near.get(via, []):
                    if x not in seen:
                        found[x] = min(found.get(x, (via, e)), (via, e))
            hits += [(step, *f, x) for x, f in found.items()]
            seen |= set(found)
            frontier = list(found)
        want += [(anchor, x, step) for step, _, _, x in sorted(hits)[:3]]
    df = spark.createDataFrame(edges, "csc_id string, edge_id string, edge_type string, source_id string, target_id string")
    anchors = spark.createDataFrame([("r", f"n{i}") for i in range(40)], "csc_id string, anchor string")
    assert rows(repository.expand(anchors, df, 2, 3), "anchor", "node_id", "distance") == sorted(want, key=str)


def test_line_chunks_keep_numbers(spark):
    s = spark.createDataFrame([("r", "a", "\n".join(f"l{i}" if i < 40 or i >= 80 else "" for i in range(85))), ("r", "b", None), ("r", "c", "  \n")], "csc_id string, path string, text string")
    assert rows(repository.line_chunks(s), "chunk_id") == [("code::a::1-40",), ("code::a::81-85",)]


def test_imports(spark):
    s = spark.createDataFrame([
        ("r", "pkg/__init__.py", [], [], ""), ("r", "pkg/util.py", ["import pkg", "from other.util import x"], [], ""), ("r", "other/util.py", ["import util, pkg.util as u"], [], ""),
        ("r", "web/a.ts", ["import x from './b'", "import '../web/dir'", "import z from 'c.js'", "import q from 'lib/deep'"], [], ""), ("r", "web/b.ts", [], [], ""), ("r", "web/dir/index.js", [], [], ""), ("r", "src/lib/deep.ts", [], [], ""),
        ("r", "src/main.rs", ["use crate::net::Conn;", "use std::io;"], [], ""), ("r", "src/net.rs", ["use super::main::x;"], [], ""), ("r", "inc/one.hpp", [], [], ""), ("r", "m.cpp", ['#include "one.hpp"', "#include <vector>", '#include "inc/one.hpp"'], [], ""),
        ("r", "A.java", ["package p;", "import p.A;", "import p.*;"], ["A"], ""), ("r", "B.cs", ["using N.S;"], [], "namespace N.S {}"), ("r", None, ["import a"], [], ""), ("r", "n.py", None, None, None)],
        "csc_id string, path string, imports array<string>, classes array<string>, text string")
    got = {(r["path"], r["key"]): (r["status"], r["target"]) for r in imports.resolved(s).collect()}
    assert got["pkg/util.py", "pkg"] == ("resolved_exact", "pkg/__init__.py") and got["pkg/util.py", "other.util"][1] == "other/util.py"
    assert got["other/util.py", "util"] == ("unresolved", None) and got["other/util.py", "pkg.util"][1] == "pkg/util.py"
    assert got["web/a.ts", "./b"] == ("resolved_heuristic", "web/b.ts") and got["web/a.ts", "../web/dir"][1] == "web/dir/index.js" and got["web/a.ts", "lib/deep"][1] == "src/lib/deep.ts" and got["web/a.ts", "c.js"][1] is None
    assert got["src/main.rs", "crate::net::Conn"][1] == "src/net.rs" and got["src/main.rs", "std::io"][1] is None
    assert got["m.cpp", "one.hpp"] == ("resolved_heuristic", "inc/one.hpp") and got["m.cpp", "vector"] == ("unresolved", None) and got["m.cpp", "inc/one.hpp"] == ("resolved_exact", "inc/one.hpp")
    assert got["A.java", "p.A"][1] == "A.java" and got["A.java", "p.*"][1] is None and got["B.cs", "N.S"][1] == "B.cs"


DIFF = """diff --git a/a.py b/a.py
index 1..2
--- a/a.py
+++ b/a.py
@@ -1 +1 @@
-def old():
+def new():
+import os
-x = 1
diff --git a/n.md b/n.md
--- /dev/null
+++ b/n.md
+# only a heading
diff --git a/gone.rs b/gone.rs
--- a/gone.rs
+++ /dev/null
-let x = 1;
---- a rule
"""


def test_diffs(spark):
    d = changes.diff_lines(spark.createDataFrame([("1", DIFF), ("2", ""), ("3", None)], "diff_id string, text string"))
    got = changes.file_changes(d, ["diff_id", "path"])
    assert rows(got, "path", "added", "removed", "signatures", "dependencies", "comment_only", "change_kind", "section") == [
        ("a.py", 2, 2, 2, 1, False, "interface_change", "Interface Design"), ("gone.rs", 0, 1, 0, 0, False, "logic_change", "Detailed Design"), ("n.md", 1, 0, 0, 0, True, "documentation_only", "Referenced Documents")]
    lines = spark.createDataFrame([("class Planner: run_plan()",), ("interface Buildable",), ("strategy_factory(x)",), ("",)], "l string")
    assert {n for r in lines.select(changes.changed_names(lines.l)).collect() for n in r[0]} == {"Planner", "run_plan", "Buildable", "strategy_factory"}


def test_windows_and_spans(spark):
    d = spark.createDataFrame([("r", f"c{i}", i, s) for i, s in enumerate([1, 7, 8, 2, 9])] + [("q", "z", 0, 3), ("q", "y", 1, 3)], "csc_id string, commit_id string, at int, strength int")
    assert rows(history.strong_windows(d), "csc_id", "window", "first_commit", "last_commit", "commits") == [("q", 1, "z", "z", 1), ("r", 1, "c1", "c2", 2), ("r", 2, "c4", "c4", 1)]
    s = spark.createDataFrame([("f", 1, 3), ("f", 2, 2), ("f", 4, 5), ("f", 9, 10)], "k string, start int, end int")
    assert rows(history.merged_spans(s, ["k"]), "start", "end", "spans") == [(1, 5, 3), (9, 10, 1)]
    e = spark.createDataFrame([("f", "e", 5, 20), ("f", "out", 30, 31)], "k string, excerpt string, a int, z int")
    g = spark.createDataFrame([("f", 10, 10, 15), ("f", 16, 16, 40)], "k string, segment int, start int, end int")
    assert rows(history.clipped(e, g, ["k"]), "excerpt", "start", "end", "segment") == [("e", 10, 15, 10), ("out", 30, 31, 16)]


def test_greedy_bins(spark):
    u = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 4, 5, 1])] + [("b", 0, None), ("b", 1, 9), ("b", 2, 1)], "k string, i int, n int")
    assert rows(history.greedy_bins(u, "k", ["i"], "n", 5), "k", "i", "bin") == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 0, 0), ("b", 1, 0), ("b", 2, 1)]


def test_broken_manifests():
    assert manifests.parse("x/pyproject.toml", "= bad")[2][0][0] == "toml_parse_failed" and manifests.parse("package.json", "[]")[2] == [("json_shape_invalid", "expected object")]
    assert manifests.parse("pom.xml", "<a>")[2][0][0] == "xml_parse_failed" and manifests.parse("README.md", "x")[0] is None
    assert manifests.parse("pyproject.toml", '[tool.poetry.dependencies]\npython = "3"\nhttpx = {version = "1"}\n[tool.poetry.group.docs.dependencies]\nmk = "1"')[1] == [("httpx", "runtime", None, '{"version": "1"}'), ("mk", "development", "docs", "1")]


def test_git_sources(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    for i, name in enumerate(["a.py", "b.md", "c.rs"]):
        (tmp_path / name).write_text(f"# {i}\n")
        run("add", "-A")
        run("commit", "-qm", f"add {name}")
    run("tag", "v1")
    git.register(spark)
    log = spark.read.format("git_log").option("repo", str(tmp_path)).load()
    assert [r["subject"] for r in log.orderBy("seq").collect()] == ["add a.py", "add b.md", "add c.rs"]
    shas = [r["sha"] for r in log.orderBy("seq").collect()]
    assert spark.read.format("git_log").option("repo", str(tmp_path)).option("previous", shas[0]).load().count() == 2
    assert rows(spark.read.format("git_tree").option("repo", str(tmp_path)).option("files", "2").load(), "path", "text") == [("a.py", "# 0\n"), ("b.md", "# 1\n"), ("c.rs", "# 2\n")]
    first = log.orderBy("seq").first()["sha"]
    pair = spark.read.format("git_diff").option("repo", str(tmp_path)).option("base", first).load()
    assert pair.count() == 1 and pair.first()["base"] == first
    diffs = spark.read.format("git_diff").option("repo", str(tmp_path)).load()
    assert rows(changes.file_changes(changes.diff_lines(diffs), ["path"]), "path", "added") == [("a.py", 1), ("b.md", 1), ("c.rs", 1)]
    assert git.is_strict_ancestor(str(tmp_path), shas[0], "HEAD") and not git.is_strict_ancestor(str(tmp_path), "HEAD", "HEAD")
    assert git.ancestors(log, log).count() == 3
    last = log.orderBy(F.desc("seq")).limit(1)
    assert git.ancestors(log, last).count() == 2 and git.ancestors(log, last.limit(0)).count() == 0
    assert rows(git.tags_by_commit(log, spark.createDataFrame([("v1", shas[2])], "tag string, sha string")), "sha", "tags") == [(shas[2], ["v1"])]
    with pytest.raises(git.GitError):
        git.resolve(str(tmp_path), "nowhere")


def test_stores(spark, tmp_path):
    c = chunks(spark, ("a", "doc.md", "route planning", None), ("b", "doc.md", "storage", None))
    stores.write_store(c, f"{tmp_path}/store")
    assert rows(stores.read_postings(spark, f"{tmp_path}/store", ["route", "absent"]), "term", "chunk_id", "tf") == [("route", "a", 1)]
    (tmp_path / "x.jsonl").write_text('{"csc_id":"r","chunk_id":"a"}\n\n{"csc_id":"r","chunk_id":"b"}\n')
    assert stores.read_jsonl(spark, f"{tmp_path}/x.jsonl", stores.CHUNKS).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"csc_id":\n')
    with pytest.raises(Exception):  # noqa: B017, PT011
        stores.read_jsonl(spark, f"{tmp_path}/bad.jsonl", stores.CHUNKS).collect()
    (tmp_path / "src/t").mkdir(parents=True)
    for name in ("src/a.py", "src/t/a_test.py", "src/notes"):
        (tmp_path / name).write_text("x")
    assert rows(stores.scan_files(spark, f"{tmp_path}/src", ["*.py"], ["*_test.py"]), "path", "language", "text") == [("a.py", "python", "x"), ("notes", "unknown", "x")]
    f = spark.createDataFrame([("g1", "a", 1), ("g2", "b", 1)], "fragment_group string, k string, v int")
    stores.overwrite_fragments(f, f"{tmp_path}/frag")
    stores.overwrite_fragments(f.filter("fragment_group = 'g2'").withColumn("v", F.lit(2)), f"{tmp_path}/frag")
    assert rows(spark.read.parquet(f"{tmp_path}/frag"), "k", "v") == [("a", 1), ("b", 2)]


def test_model_calls(spark):
    r = spark.createDataFrame([("s", "good"), ("s", "bad"), ("s", "dies")], "system string, user string")

    def call(system: str, user: str, schema: str) -> str:
        if user == "dies":
            raise TimeoutError
        return '{"ok":1}' if user == "good" else "no json"

    assert rows(generation.generate(r, "x", call), "user", "status") == [("bad", "llm_failed"), ("dies", "llm_failed"), ("good", "scored")]
    assert {x["status"] for x in generation.generate(r, "x").collect()} == {"heuristic_only"}


def test_documents(spark):
    s = spark.createDataFrame([("r", 2, "B", "  "), ("r", 1, "A", "text"), ("r", 2, "C", None)], "k string, place int, title string, body string")
    assert rendering.documents(s, ["k"]).first()["markdown"] == "# r\n\n## 1. A\n\ntext\n\n## 2. B\n\nTBD\n\n## 3. C\n\nTBD\n"


def test_stream(spark, tmp_path):
    from datetime import datetime

    e = [(1, datetime(2024, 1, 1, 0, 5), 1, "a", 1.0, None), (1, datetime(2024, 1, 1, 0, 5), 1, "a", 1.0, None), (2, datetime(2024, 1, 1, 0, 50), 1, "a", 2.0, None), (3, datetime(2024, 1, 1, 9, 0), 1, "b", 1.0, None)]
    spark.createDataFrame(e, stream.EVENTS).write.parquet(f"{tmp_path}/in")
    out = stream.windowed_counts(stream.read_events(spark, f"{tmp_path}/in"))
    q = out.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("counts"), "event_type", "events", "value") == [("a", 2, 3.0)]


def test_line_units_and_corpus(spark):
    from repolith.operators import corpus

    f = spark.createDataFrame([("r", "a", "a b c\nd e f\ng h i\n"), ("r", "b", "one\n" * 3), ("r", "c", None), ("r", "d", "w " * 20)], "csc_id string, path string, text string")
    assert rows(corpus.line_units(f, 5), "path", "line_start", "line_end", "token_count") == [("a", 1, 1, 3), ("a", 2, 2, 3), ("a", 3, 3, 3), ("b", 1, 3, 3), ("d", 1, 1, 20)]
    two = spark.createDataFrame([("r", "a", "a b\nc d"), ("r", "b", "e f g h")], f.schema)
    assert rows(corpus.corpus(two, 16), "path", "bin") == [("a", 0), ("b", 0)]


def test_workspace(tmp_path, spark):
    from repolith import cli, workspace

    assert workspace.Layout("/x/", "w").tool("ask") == "/x/workspaces/w/tools/ask"
    assert workspace.store_root("/a/b/postings/") == "/a/b" == workspace.store_root("/a/b")
    (tmp_path / "p.yaml").write_text("sources: [src]\ntop_k: 3\n")
    c = workspace.load_config(f"{tmp_path}/p.yaml")
    assert c.top_k == 3 and c.sources == [str((tmp_path / "src").resolve())]
    for bad in ('{"nope": 1}', '{"top_k": "x"}', "[]"):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ValueError):
            workspace.load_config(f"{tmp_path}/b.json")
    assert workspace.as_json(spark.createDataFrame([(1, "x")], "b int, a string")).first()[0] == '{"a":"x","b":1}'
    metrics: list = []
    with workspace.timed(metrics, "s"):
        pass
    assert metrics[0]["stage"] == "s"
    assert cli.main(["list"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "x"], spark)


def test_bodies_round_trip(spark):
    s = spark.createDataFrame([("r", 1, "A", "one\n\n### deep\n\ntwo"), ("r", 2, "B", "x")], "k string, place int, title string, body string")
    assert rows(rendering.bodies(rendering.documents(s, ["k"]), ["k"]), "number", "title", "body") == [(1, "A", "one\n\n### deep\n\ntwo"), (2, "B", "x")]
