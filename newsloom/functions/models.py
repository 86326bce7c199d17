"""Model calls as columns: only the texts travel to Python, the rest of the row stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.providers import TextModel

_REPLY = pa.struct([("response", pa.string()), ("status", pa.string())])


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, parallelism: int | None = None, *keys: str) -> DataFrame:
    """Rows dealt out for model calls, which take far longer than their shuffle. The number
    of tasks is set, so that adaptive execution does not put small rows together again."""
    if parallelism is None:
        parallelism = shuffle_tasks(df.sparkSession)
    return df.repartition(parallelism, *keys)


def model_call(
    ask: Callable[[TextModel, str | None, str | None], dict], provider: Callable[[], TextModel]
) -> Callable[[Column, Column], Column]:
    """Column function (prompt, payload) -> `struct<response, status>`.

    The model is created once per task. The call is declared non-deterministic, so that
    the optimizer neither repeats nor moves it.
    """

    @F.arrow_udf("struct<response: string, status: string>")
    def call(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = provider()
        for prompts, payloads in batches:
            pairs = zip(prompts.to_pylist(), payloads.to_pylist())
            yield pa.array([ask(model, prompt, payload) for prompt, payload in pairs], type=_REPLY)

    return call.asNondeterministic()
