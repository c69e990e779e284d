"""All queries run on the smallest data, with their SQL where there is one; skipped where the data are not mounted."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import compare

DATA = Path("/root/testdata/sf0.001")
CORE = sorted(n for n, f in entry.queries().items() if not f.__module__.startswith("repolith.llm"))

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    got, sql = [tuple(r) for r in df.collect()], entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert compare.rows(df.columns, got) == compare.rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["workspace_id", "checkpoint_id", "fragment_id", "change_kind"]


def test_searches_reach_repositories_without_workspace(spark, tmp_path):
    spark.createDataFrame([("csc-hot", f"c{i}", "code", f"f{i}.py", f"def shared_word(): return value_{i}", None, 1, 1) for i in range(30)] + [("csc-1", "c1", "code", "a.py", "def shared_word(): pass", None, 1, 1)],
                          "csc_id string, chunk_id string, source_type string, source_path string, text string, section_id string, line_start int, line_end int").write.parquet(f"{tmp_path}/knowledge_chunks.parquet")
    spark.createDataFrame([(20, "shared_word value_7", "csc-hot"), (21, "shared_word", "csc-hot"), (40, None, "csc-hot"), (60, "shared_word", None), (80, "shared_word", "csc-1")], "doc_id long, text string, csc_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("csc-hot", "f7.py", "f8.py")], "csc_id string, source_path string, target_path string").write.parquet(f"{tmp_path}/dependency_records.parquet")
    run = lambda name: entry.queries()[f"{name}_documents"](spark, str(tmp_path)).collect()
    scores = run("ref_a03_bm25")
    assert {(x["csc_id"], x["question_id"]) for x in scores} == {("csc-hot", "20"), ("csc-1", "80")} and len(scores) == 31
    assert [x["chunk_id"] for x in run("ref_t01_top_k") if x["csc_id"] == "csc-hot" and x["rank"] == 1] == ["c7"]
    assert {x["csc_id"] for x in run("ref_r01_rerank")} == {"csc-hot", "csc-1"}
    assert {(x["question_id"], x["screened"]) for x in run("ref_d10_screening")} == {("20", 30), ("80", 1)}
