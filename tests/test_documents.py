from __future__ import annotations

import json
import subprocess

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repolith import pipelines
from repolith.functions.globs import ignored
from repolith.operators import analyzers, benchmark, fragments, generation, outline, providers, rendering, repository, retrieval, usage, validation
from repolith.sources import git, stores

SCAN = "csc_id string, path string, language string, text string, functions array<string>, classes array<string>, docstrings array<string>, imports array<string>"
NODES = "csc_id string, node_id string, node_type string, label string, path string, symbol_kind string, symbol_name string, qualified_name string, section_id string, line_start int, recorded_at timestamp, removed_at timestamp, terms string, kind string"
EDGES = "csc_id string, edge_id string, edge_type string, source_id string, target_id string, reason string, recorded_at timestamp, status string"
DEPS = "csc_id string, dependency_id string, source_path string, language string, raw_dependency string, normalized_key string, dependency_kind string, resolution_status string, target_path string, recorded_at timestamp"
CHUNKS = "csc_id string, chunk_id string, source_type string, source_path string, text string, section_id string, line_start int, line_end int, words int, dl string"


def test_ignore_lines(spark):
    paths = ["a.json", "x/keep.json", "build/a.py", "rebuild/a.py", "tools/a.txt", "x/tools/a.txt", "lib/p/q/flush_a.py", "lib/flush_b.py", "a/internal/b.py", "# comment", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    lines = ["# comment", "*.json", "!keep.json", "build/", "/tools/*.txt", "lib/**/flush_*", "internal/", " "]
    assert rows(df.filter(ignored(df.p, lines)), "p") == [("a.json",), ("a/internal/b.py",), ("build/a.py",), ("lib/flush_b.py",), ("lib/p/q/flush_a.py",), ("tools/a.txt",)]
    assert df.filter(ignored(df.p, [])).count() == 0


MARKDOWN = "# r\n\n## 1. One\n\nIn this release it moved.\n### A\n\nfirst\n\nsecond\n### B\n- x\n### B\nTBD\n### C\n\nTBD\n\nreal\n### D\n- Scope: all\n\n## 2. Two\n\nTBD - later\nsee module::a/b.py\nNo algorithm capsules were emitted for this checkpoint.\n"


def test_findings(spark):
    docs = spark.createDataFrame([("r", MARKDOWN), ("e", ""), ("n", None)], "csc_id string, markdown string")
    s = validation.sections(docs, ["csc_id"])
    assert rows(s, "csc_id", "title", "line") == [("r", "1. One", 3), ("r", "2. Two", 23)]
    found = validation.subsection_findings(docs, ["csc_id"])
    assert rows(found, "check_id", "reference", "line_number") == sorted([("dependency_subsection_shape_invalid", "B", None), ("dependency_subsection_shape_invalid", "D", 20), ("dependency_summary_tbd", "C", 15), ("algorithm_capsule_thin", "D", 20)], key=str)
    lined = validation.line_findings(docs, ["csc_id"], ("2. Two",))
    assert rows(lined, "check_id", "severity", "line_number") == [("contradictory_tbd_phrase", "warning", 25), ("raw_internal_id_leak", "error", 26), ("release_note_phrase", "warning", 5), ("weak_core_section", "error", 27)]
    every = validation.ordered(found.unionByName(lined), ["csc_id"]).orderBy("place").collect()
    assert [x["severity"] for x in every] == ["error"] * 4 + ["warning"] * 4 and all(x["aborts"] for x in every)
    assert [tuple(x) for x in validation.counts(lined, ["csc_id"]).collect()] == [("r", 2, 2)]


def test_section_order(spark):
    docs = spark.createDataFrame([("r", "## A\nx\n## B\ny\n## C\n")], "csc_id string, markdown string")
    manifest = spark.createDataFrame([("r", "a", "A", 1), ("r", "b", "B", 2)], "csc_id string, section_id string, title string, position int")
    outline_ = spark.createDataFrame([("r", "a", "A", "included", 1), ("r", "b", "B", "included", 2), ("r", "c", "C", "omitted", 3), ("r", "d", "D", "included", 4)], "csc_id string, section_id string, title string, status string, position int")
    got = validation.section_findings(outline_, manifest, docs, ["csc_id"])
    assert rows(got, "check_id", "section_id", "reference") == sorted([("included_section_missing", "d", "D"), ("omitted_section_rendered", "c", "C"), ("render_manifest_mismatch", None, "A -> B -> C")], key=str)


def test_bodies_with_headings_survive(spark):
    body = "## not mine\n\\## nor this\ntext\n### sub"
    s = spark.createDataFrame([("r", "t", 1, body), ("r", "u", 2, None)], "csc_id string, title string, place int, body string")
    assert rows(rendering.bodies(rendering.documents(s, ["csc_id"]), ["csc_id"]), "number", "title", "body") == [(1, "t", body), (2, "u", "TBD")]


def test_gate(spark):
    answers = []
    for case in range(5):
        for v, score in (("baseline", "2"), ("semantic-clustering", "3/5"), ("semantic-structure-context", "4"), ("semantic-structure-context-llm-draft", "9"), ("semantic-structure-context-llm-repair", "4")):
            answers += [(f"c{case}", v, d, score, 1) for d in benchmark.DIMENSIONS] + [(f"c{case}", v, "coverage", "n/a", 0), (f"c{case}", v, "other", "5", 1)]
    answers = spark.createDataFrame(answers, "case_id string, variant_id string, dimension string, raw string, at int")
    scores = benchmark.rubric(answers)
    assert scores.count() == 5 * 5 * 7 and scores.filter("dimension = 'coverage'").groupBy().max("score").first()[0] == 5
    facts = answers.select("case_id", "variant_id").distinct().withColumns({"risks": F.lit(0), "tbd": F.lit(False), "failed": F.lit(False), "errors": F.when(F.col("variant_id").endswith("draft"), 1).otherwise(0)})
    gate = {r["variant_id"]: (r["passes"], r["reasons"], r["wins"]) for r in benchmark.promotion_gate(scores, benchmark.reports(scores, facts)).collect()}
    assert gate == {"semantic-clustering": (True, [], 5), "semantic-structure-context": (True, [], 5), "semantic-structure-context-llm-draft": (False, ["validation"], 5), "semantic-structure-context-llm-repair": (False, ["score", "wins"], 0)}
    raw = spark.createDataFrame([(x,) for x in ("true", "false", " 3 ", "2.5", "7", "-4", "4 of 5", "x", "", None)], "r string")
    assert [r[0] for r in raw.select(benchmark.judge_score(raw.r)).collect()] == [1, 0, 3, 2, 5, 0, 4, None, None, None]
    missing = benchmark.focus_coverage(spark.createDataFrame([("c", "small")], "case_id string, tag string")).filter("NOT covered")
    assert missing.count() == 4


def tables(spark, scan=(), nodes=(), edges=(), deps=(), chunks=()):
    return pipelines.Tables(*(spark.createDataFrame(list(r), s) for r, s in ((scan, SCAN), (nodes, NODES), (edges, EDGES), (deps, DEPS), (chunks, CHUNKS))))


def test_composed_runs_on_empty_and_null_rows(spark):
    questions = spark.createDataFrame([("r", "1", "parse request")], "csc_id string, question_id string, question string")
    t = tables(spark)
    documents, findings = pipelines.generate_documents(t)
    assert documents.count() == 0 and findings.count() == 0 and pipelines.answer_evidence(t, questions).count() == 0 and outline.insights(t.edges, t.nodes, t.dependencies).count() == 0
    nothing = (None,) * 8
    t = tables(spark, [nothing, ("r", "src/api_router.py", None, "x = 1\n", ["parse_request"], None, ["It must be strict.\n"], ["import requests"]), ("r", "src/api_router.py", None, None, None, ["RequestState"], None, None)], [(None,) * 14], [nothing], [(None,) * 10, ("r", "d", "src/api_router.py", "python", "requests", "requests", "import", " Unresolved", None, None)],
               [(None,) * 10, ("r", "c", "code", "src/api_router.py", "parse the request", None, 1, 1, 0, "x")])
    assert rows(pipelines.answer_evidence(t, questions), "chunk_id", "rank", "status", "quote") == [("c", 1, "grounded", "parse the request")]
    assert "grounded" in pipelines.answer_markdown(pipelines.answer_evidence(t, questions)).first()["markdown"]
    assert rows(outline.interface_kinds(t.scan, t.nodes), "path", "kind", "title") == [("src/api_router.py", "http_api", "HTTP API: Api_router")]
    assert rows(outline.assumptions(t.scan), "text") == [("It must be strict.",)] and rows(outline.data_structures(t.scan, t.nodes), "name", "kind") == [("RequestState", "class")]
    assert rows(usage.gates(usage.usage(t.scan, t.dependencies)), "package", "modules", "strong", "groupable") == [("requests", 1, True, False)]
    told = usage.narratives(usage.usage(t.scan, t.dependencies)).first()
    assert told["general"].startswith("requests is a Python HTTP client") and told["basis"] == "project_evidence"
    documents, findings = pipelines.generate_documents(t)
    markdown = {r["csc_id"]: r["markdown"] for r in documents.collect()}["r"]
    assert "introduction" in markdown and "requests imports" not in markdown and findings.filter("aborts").count() == 0
    assert fragments.file_fragments(t.scan, t.nodes, t.dependencies, t.chunks).filter("edge_type = 'contains' AND csc_id = 'r'").count() == 1


def test_grouped_tooling(spark):
    used = spark.createDataFrame([("r", "python", "pytest-x", "pytest-x", "test", 0, 0, None), ("r", None, "a", "a", "test", 0, 0, None), ("r", "go", "g", "g", "runtime", 0, 0, None)], "csc_id string, ecosystem string, package string, name string, role string, modules long, subsystems long, first_module string")
    assert rows(usage.narratives(used), "package", "render_style", "group_title") == [("a", "grouped_tooling", "Project Test Tooling"), ("g", "standard", None), ("pytest-x", "grouped_tooling", "Project Python Test Tooling")]


def test_expansion_keeps_the_budget(spark):
    initial = spark.createDataFrame([("r", "q", "c0", 1)], "csc_id string, question_id string, chunk_id string, rank int")
    seeds = spark.createDataFrame([("r", "q", "file::d/f0")], "csc_id string, question_id string, node_id string")
    links = spark.createDataFrame([("r", "dir::d", f"file::d/f{i}") for i in range(500)] + [("r", "dir::.", "dir::d")], "csc_id string, parent string, child string")
    summaries = spark.createDataFrame([("r", f"file::d/f{i}", f"s{i:03d}", "file_summary", f"d/f{i:03d}") for i in range(500)] + [("r", "dir::d", "sd", "directory_summary", "d")], "csc_id string, node_id string, chunk_id string, source_type string, source_path string")
    got = retrieval.expanded(initial, seeds, links, summaries, 3).orderBy("rank").collect()
    assert [(r["rank"], r["chunk_id"], r["origin"]) for r in got] == [(1, "c0", "initial"), (2, "sd", "hierarchy"), (3, "s001", "hierarchy"), (4, "s002", "hierarchy"), (5, "s003", "hierarchy"), (6, "s004", "hierarchy")]


def test_symbols_of_odd_texts(spark):
    files = spark.createDataFrame([("r", "a.py", None), ("r", "b.py", ""), ("r", None, "def f(): pass"), ("r", "c.go", "func ("), ("r", "d.java", "}}}{{{\nclass X {"), (None, "e.py", "class A: pass\nclass A: pass\n"), (None, "e.py", "class A: pass\nclass A: pass\n"), ("r", "f.js", "x" * 200_000)], "csc_id string, path string, text string")
    got = analyzers.symbols(files)
    assert rows(got, "path", "kind", "qualified_name", "line_start") == [("d.java", "class", "X", 2), ("d.java", "module", "d", 1), ("e.py", "class", "A", 1), ("e.py", "module", "e", 1)]
    assert analyzers.symbols(files.limit(0)).count() == 0
    stream = repository.scan_stream(files.withColumns({"functions": F.array().cast("array<string>"), "classes": F.array().cast("array<string>")}), 3)
    assert rows(stream.filter("csc_id = 'r'"), "path", "n", "symbols") == [("a.py", 1, 0), ("b.py", 2, 0), ("c.go", 3, 0)]


def test_providers(spark):
    sent = []

    def transport(url, headers, body):
        sent.append((url, headers, json.loads(body)))
        said = '{"answer": "yes"}'
        return json.dumps({"choices": [{"message": {"content": said}}], "candidates": [{"content": {"parts": [{"text": said}]}}], "content": [{"type": "tool_use", "input": {"answer": "yes"}}], "message": {"content": said}})

    schemas = {"summary": {"type": "object", "required": ["answer"]}}
    for name in providers.PROVIDERS:
        assert json.loads(providers.provider_call(name, "m", schemas, "key", transport=transport)("system", "user", "summary")) == {"answer": "yes"}
    assert len({url for url, _, _ in sent}) == 5 and "key" not in str(sent[-1][1])
    for bad in (lambda: providers.provider_call("none", "m", {}), lambda: providers.provider_call("openai", "m", {}), lambda: providers.provider_call("openai", "m", {"summary": {"required": ["more"]}}, "k", transport=transport)("s", "u", "summary"), lambda: providers.provider_call("ollama", "m", {}, transport=lambda *_: "{}")("s", "u", "summary")):
        with pytest.raises(providers.ProviderError):
            bad()
    requests = spark.createDataFrame([("s", "u")], "system string, user string")
    assert generation.generate(requests, "summary", lambda *_: "no json").first()["status"] == "llm_failed"


def test_index_as_retriever(spark):
    chunks = tables(spark, chunks=[("r", "a", "code", "a.py", "alpha beta", None, 1, 2, 0, "x"), ("r", "b", "code", "b.py", "beta", None, 1, 2, 0, "x")]).chunks.drop("words", "dl")
    index = providers.LexicalIndex(chunks)
    q = spark.createDataFrame([("r", "1", "alpha")], "csc_id string, question_id string, question string")
    assert index.search(q, 1).first()["chunk_id"] == "a"
    index.update(index.index, chunks.filter("chunk_id = 'b'").withColumn("text", F.lit("alpha alpha")))
    assert index.search(q, 1).first()["chunk_id"] == "b"


def test_stores_with_lost_parts(spark, tmp_path):
    nodes = [("r", "sym::a.py::function::f", "symbol", "f", "a.py", "function", "f", "f", None, 1, None, None, "", "")]
    edges = [("r", "e1", "defines", "file::a.py", "sym::a.py::function::f", None, None, "")]
    t = tables(spark, nodes=nodes, edges=edges)
    t.nodes.write.parquet(f"{tmp_path}/nodes")
    t.edges.write.parquet(f"{tmp_path}/edges")
    (tmp_path / "symbols").mkdir()
    (tmp_path / "symbols" / "part.parquet").write_text("no parquet")
    graph = stores.load_graph(spark, str(tmp_path))
    assert graph["adjacency"].count() == 2 and rows(graph["symbols"], "symbol") == [("sym::a.py::function::f",)]
    good = [("x", "meta", '{"fingerprint": "1"}'), ("x", "node", '{"id": "n"}')]
    frame = lambda r: spark.createDataFrame(r, "fragment_id string, row_type string, payload string")
    assert stores.read_fragments(frame(good)).count() == 2
    for bad in ([*good, ("x", "node", "{broken")], [*good, ("x", "other", "{}")], [("y", "node", "{}")]):
        with pytest.raises(Exception, match="fragment"):
            stores.read_fragments(frame(bad)).collect()


def test_source_roots(spark):
    scan = tables(spark, [("r", "src/a.py", None, None, None, None, None, None), ("q", "b.py", None, None, None, None, None, None)]).scan
    assert rows(repository.source_roots(scan, ["./src/", "lib", "."]), "csc_id", "root", "status") == [("q", ".", "analysed"), ("q", "lib", "missing"), ("q", "src", "missing"), ("r", ".", "analysed"), ("r", "lib", "missing"), ("r", "src", "analysed")]
    for outside in ("/etc", "../x", "a/../../b"):
        with pytest.raises(ValueError, match="outside"):
            repository.source_roots(scan, [outside])


def test_previous_benchmark_commit(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    shas = []
    for i in range(25):
        (tmp_path / "a.txt").write_text(str(i))
        run("add", ".")
        run("commit", "-q", "-m", f"c{i}")
        shas.append(run("rev-parse", "HEAD"))
    git.register(spark)
    log = spark.read.format("git_log").option("repo", str(tmp_path)).option("firstParent", "true").load()
    none = spark.createDataFrame([], "tag string, sha string")
    assert tuple(git.previous_benchmark(log, none).first()) == (shas[4], "distance")
    tags = spark.createDataFrame([("v1", shas[7]), ("v2", shas[9]), ("v3", shas[24])], "tag string, sha string")
    assert tuple(git.previous_benchmark(log, tags).first()) == (shas[9], "tag")
    assert git.previous_benchmark(log.filter("seq = 0"), none).count() == 0
