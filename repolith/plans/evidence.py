"""Queries over evidence, manifests, symbols of texts, documents and streams (X1, X2, X6-X15, A11, A13, A14, A19, A21, A29, A30, F6, F8, J9, J10, J15, J16, J22, T6, T7, V1, V3, V5, V8-V12, W8, W9, D1, D2, D11)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.text import tokens
from repolith.operators import analyzers, generation, manifests, rendering
from repolith.plans.repository import _LANGUAGE, _SUB
from repolith.plans.retrieval import _TOK
from repolith.session import checkpoint_dir, load
from repolith.streaming import events as stream

QUERIES, SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Small manifests of every kind with the (name, role) pairs that they declare.
MANIFESTS = [
    ("pyproject.toml", '[project]\ndependencies = ["requests>=2", "pydantic>=2"]\n[project.optional-dependencies]\ndev = ["pytest>=8"]\n', [("requests", "runtime"), ("pydantic", "runtime"), ("pytest", "development")]),
    ("package.json", '{"dependencies":{"react":"^18"},"devDependencies":{"eslint":"^9"},"bundledDependencies":["left"]}', [("react", "runtime"), ("eslint", "development"), ("left", "build")]),
    ("package-lock.json", '{"packages":{"":{"dependencies":{"react":"^18"},"devDependencies":{"vitest":"^1"}},"node_modules/x":{}}}', [("react", "runtime"), ("vitest", "development")]),
    ("Cargo.toml", '[dependencies]\nserde_json = "1"\n[dev-dependencies]\ninsta = "1"\n[build-dependencies]\ncc = "1"\n', [("serde-json", "runtime"), ("insta", "test"), ("cc", "build")]),
    ("go.mod", "module m\nrequire (\n  a.b/c v1.8.0\n  d.e/f v0.1.0 // indirect\n)\nrequire g.h/i v2.0.0\n", [("a.b/c", "runtime"), ("g.h/i", "runtime")]),
    ("requirements-dev.txt", "pytest>=8\n# note\n-r base.txt\nmypy==1.11\n", [("pytest", "development"), ("mypy", "development")]),
    ("Pipfile", '[packages]\nflask = "*"\n[dev-packages]\nblack = "*"\n', [("flask", "runtime"), ("black", "development")]),
    ("Pipfile.lock", '{"default":{"flask":{"version":"==3"}},"develop":{"black":{}}}', [("flask", "runtime"), ("black", "development")]),
    ("pom.xml", '<project xmlns="urn:p"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><scope>test</scope></dependency></dependencies><build><plugins><plugin><artifactId>p</artifactId></plugin></plugins></build></project>', [("g:a", "test"), ("plugin:p", "plugin")]),
    ("build.gradle", "dependencies {\n  implementation 'g:a:1.0'\n  testImplementation(\"g:t:2\")\n  implementation(libs.slf4j)\n}\n", [("g:a", "runtime"), ("g:t", "test")]),
    ("App.csproj", '<Project><ItemGroup><PackageReference Include="Newton" Version="1"/><PackageReference Include="Style" PrivateAssets="all"/></ItemGroup></Project>', [("newton", "unknown"), ("style", "build")]),
    ("packages.lock.json", '{"dependencies":{"A":{"type":"Direct","resolved":"1"},"B":{"type":"Transitive"}}}', [("a", "unknown")]),
    ("vcpkg.json", '{"dependencies":["fmt",{"name":"zlib"}]}', [("fmt", "runtime"), ("zlib", "runtime")]),
    ("conanfile.txt", "[requires]\nfmt/9.0\n[tool_requires]\ncmake/3.2\n", [("fmt", "runtime"), ("cmake", "toolchain")]),
    ("conanfile.py", "class C:\n    requires = ['fmt/9.0', 'zlib/1']\n    test_requires = 'gtest/1'\n", [("fmt", "runtime"), ("zlib", "runtime"), ("gtest", "test")]),
    ("meson.build", "d = dependency('glib')\n", [("glib", "runtime")]), ("CMakeLists.txt", "find_package(Boost REQUIRED)\n", [("boost", "build")]),
    ("WORKSPACE", "http_archive(\n  name = 'rules_go',\n)\n", [("rules_go", "build")]),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{n}', '{r}')" for p, _, found in MANIFESTS for n, r in found) + ") AS v(path, name, role)")
def ref_x06_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of one small manifest of every kind."""
    files = spark.createDataFrame([("demo", p, t) for p, t, _ in MANIFESTS], "csc_id string, path string, text string")
    return manifests.declarations(files).filter("kind = 'declaration'").select("path", "name", "role")


@query("SELECT * FROM (VALUES ('requirements-dev.txt', 'requirements_include_skipped'), ('build.gradle', 'gradle_dynamic_skipped')) AS v(path, code)")
def ref_x14_manifest_warnings(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([("demo", p, t) for p, t, _ in MANIFESTS], "csc_id string, path string, text string")
    return manifests.declarations(files).filter("kind = 'warning'").select("path", F.col("name").alias("code"))


@query()
def ref_x01_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Functions, classes and imports of every text."""
    return analyzers.summaries(load(spark, d, "scan_records"))


_SYM = "sym AS (SELECT DISTINCT csc_id, node_id, path, symbol_name AS name FROM graph_nodes WHERE node_type = 'symbol' AND symbol_name IS NOT NULL)"


@query(f"WITH m AS (SELECT DISTINCT csc_id, path, {_SUB} AS subsystem_id, {_LANGUAGE} AS language FROM scan_records WHERE path IS NOT NULL), i AS (SELECT DISTINCT csc_id, source_path, target_path FROM dependency_records WHERE target_path IS NOT NULL) SELECT a.csc_id, a.subsystem_id AS from_subsystem, b.subsystem_id AS to_subsystem, count(*) AS imports FROM i JOIN m a ON a.csc_id = i.csc_id AND a.path = i.source_path JOIN m b ON b.csc_id = i.csc_id AND b.path = i.target_path GROUP BY ALL")
def ref_j22_subsystem_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports between subsystems through the membership of files."""
    from repolith.operators.repository import subsystem

    m = load(spark, d, "scan_records").filter("path IS NOT NULL").select("csc_id", "path").distinct().withColumn("s", subsystem(F.col("path")))
    i = load(spark, d, "dependency_records").filter("target_path IS NOT NULL").select("csc_id", "source_path", "target_path").distinct()
    j = i.join(m.select("csc_id", F.col("path").alias("source_path"), F.col("s").alias("from_subsystem")), ["csc_id", "source_path"]).join(m.select("csc_id", F.col("path").alias("target_path"), F.col("s").alias("to_subsystem")), ["csc_id", "target_path"])
    return j.groupBy("csc_id", "from_subsystem", "to_subsystem").agg(F.count("*").alias("imports"))


_SECTIONS = "s AS (SELECT csc_id, section_id AS title, min(text) AS body, min(coalesce(line_start, 0)) AS place FROM knowledge_chunks WHERE source_type = 'sdd_section' AND section_id IS NOT NULL GROUP BY ALL), n AS (SELECT csc_id, row_number() OVER (PARTITION BY csc_id ORDER BY place, title) AS number, title, coalesce(nullif(trim(body), ''), 'TBD') AS body FROM s)"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "knowledge_chunks").filter("source_type = 'sdd_section' AND section_id IS NOT NULL")
    return c.groupBy("csc_id", F.col("section_id").alias("title")).agg(F.min("text").alias("body"), F.min(F.coalesce("line_start", F.lit(0))).alias("place"))


@query(f"WITH {_SECTIONS} SELECT csc_id, number, title, body FROM n")
def ref_w08_section_numbers(spark: SparkSession, d: str) -> DataFrame:
    return rendering.numbered(_sections(spark, d), ["csc_id"])


_REQUEST = "'{\"csc\":\"' || csc_id || '\",\"files\":' || files || '}'"


@query(f"WITH f AS (SELECT csc_id, count(DISTINCT path) AS files FROM scan_records GROUP BY ALL) SELECT csc_id, {_REQUEST} AS \"user\", '{{\"schema\":\"summary\",\"digest\":\"' || sha256({_REQUEST}) || '\"}}' AS answer, 'heuristic_only' AS status FROM f")
def ref_d02_mock_answers(spark: SparkSession, d: str) -> DataFrame:
    """Requests about each repository with the deterministic answer."""
    f = load(spark, d, "scan_records").groupBy("csc_id").agg(F.count_distinct("path").alias("files"))
    requests = f.select("csc_id", *generation.prompt("Summarise the repository.", csc=F.col("csc_id"), files=F.col("files")))
    return generation.generate(requests, "summary").select("csc_id", "user", "answer", "status")


@query("SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)")
def ref_st01_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the events read as a stream, of the hours that the watermark has passed when the data end; state lies in the shared folder."""
    folder, name = checkpoint_dir(spark), f"counts_{uuid4().hex}"
    events = stream.read_events(spark, f"{d}/events.parquet*")
    done = stream.windowed_counts(events).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/{name}/state").option("path", f"{folder}/{name}/out").trigger(availableNow=True).start()
    done.awaitTermination()
    out = spark.read.schema("window_start timestamp, event_type string, events long, value double").parquet(f"{folder}/{name}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


