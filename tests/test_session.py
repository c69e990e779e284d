from __future__ import annotations

import pandas as pd

from repolith.session import checkpoint_dir, slices, spread


def test_slices():
    b = pd.DataFrame({"i": range(6), "t": ["a" * 5, None, "b" * 9, "", "c" * 30, "d"]})
    parts = list(slices(b, "t", 10))
    assert [i for p in parts for i in p["i"]] == list(range(6)) and len(parts) > 2
    assert list(slices(b.iloc[:0], "t")) == []
    assert len(list(slices(b, "t", 10**6))) == 1


def test_spread_and_checkpoint_folder(spark):
    df = spark.range(10).coalesce(1)
    assert spread(df, "id").rdd.getNumPartitions() > 1 and spread(df, "id").count() == 10
    assert spread(spark.range(0, 10, 1, 50), "id").rdd.getNumPartitions() == 50
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_nothing_outside_imports_the_text_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "repolith"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "repolith.llm" in p.read_text()]
