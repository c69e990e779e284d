from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = SparkSession.builder.master("local[4]").config(map={
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *columns: str) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
