"""Session helpers: table access and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, as the session names it in spark.checkpoint.dir.

    Only where the session names none and runs in one local process (tests), a
    temporary folder is set; on a cluster an unset folder is an error, since a
    machine-local folder would not outlive its machine.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="repolith-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for work that is heavy per byte: a few for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over enough partitions for Python work: shuffled by keys only where its input has fewer splits than there are cores."""
    spark = df.sparkSession
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(parallelism(spark), *keys)


def slices(batch: pd.DataFrame, column: str, size: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch of at most `size` characters in a column of texts, or one row: what Python builds for a text is many times its size."""
    length = batch[column].str.len().fillna(0).to_numpy(dtype="int64") if len(batch) else []
    part = (length.cumsum() // size) if len(batch) else []
    begin = 0
    for i in range(1, len(batch) + 1):
        if i == len(batch) or part[i] != part[begin]:
            yield batch.iloc[begin:i]
            begin = i
