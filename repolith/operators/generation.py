"""Model calls as a function over rows, with a deterministic answer where no model is given or one fails."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model call: system text, user text and schema name to an answer as JSON text.
Call = Callable[[str, str, str], str]


def prompt(system: str, **fields: Column) -> list[Column]:
    """Columns system and user of a request; user is JSON of the fields in alphabetical order, nulls left out."""
    return [F.lit(system).alias("system"), F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).alias("user")]


def mock_answer(schema: str, user: Column) -> Column:
    """The deterministic answer of a schema: its name and a digest of the request."""
    return F.to_json(F.struct(F.lit(schema).alias("schema"), F.sha2(user, 256).alias("digest")))


def generate(requests: DataFrame, schema: str, call: Call | None = None) -> DataFrame:
    """requests (…, system, user) with answer and status: `heuristic_only` without a model, `scored` for a valid JSON answer, else `llm_failed` with the deterministic answer.

    A failing call never fails the job. Requests are asked where their partition is.
    """
    with_mock = requests.withColumn("answer", mock_answer(schema, F.col("user")))
    if call is None:
        return with_mock.withColumn("status", F.lit("heuristic_only"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, status = [], []
            for system, user, fallback in zip(b["system"], b["user"], b["answer"], strict=True):
                try:
                    said = call(system, user, schema)
                    json.loads(said)
                    answers.append(said)
                    status.append("scored")
                except Exception:  # noqa: BLE001
                    answers.append(fallback)
                    status.append("llm_failed")
            yield b.assign(answer=answers, status=status)

    types = ", ".join(f"`{n}` {t}" for n, t in with_mock.dtypes)
    return with_mock.mapInPandas(run, types + ", status string")
