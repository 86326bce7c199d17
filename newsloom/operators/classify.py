"""Batch classification: text, batches, prompts, model calls, and results as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom import fixed_values as fv
from newsloom import schemas
from newsloom.functions.models import model_call, spread
from newsloom.functions.text import classifier_text
from newsloom.operators.responses import ResponseLog, logged
from newsloom.providers import TextModel

# Batches per bucket when the number of buckets follows from the row count.
_BATCHES_PER_BUCKET = 32

_PROMPT = (
    "Assign each of the following articles to exactly one of these categories: [{categories}]. "
    "Reply with a JSON array of objects, each with the keys id and category, and nothing else.\n"
)


def make_batches(
    articles: DataFrame,
    size: int = fv.BATCH_SIZE,
    buckets: int | None = None,
    bucket: Column | None = None,
    order: Sequence[str | Column] = ("news_id",),
) -> DataFrame:
    """`bucket, batch, ids, items`: groups of `size` articles, items as a JSON array.

    Articles are numbered within hash buckets of their id, so numbering runs on many
    tasks; only the last batch of a bucket may be short. Without `buckets` the articles
    are counted once to keep every bucket small. `bucket` replaces the hash.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    if bucket is None:
        if buckets is None:
            buckets = -(-articles.select("news_id").count() // (size * _BATCHES_PER_BUCKET))
        bucket = F.pmod(F.xxhash64("news_id"), F.lit(max(buckets, 1)))
    window = Window.partitionBy("bucket").orderBy(*order)
    numbered = articles.select(
        "*", bucket.cast("bigint").alias("bucket")
    ).select(
        "bucket",
        (F.row_number().over(window) - 1).alias("_place"),
        F.struct(
            F.col("news_id").alias("id"),
            classifier_text(F.col("title"), F.col("summary")).alias("summary"),
        ).alias("_item"),
    )
    batches = (
        numbered.withColumn("batch", F.floor(F.col("_place") / size))
        .groupBy("bucket", "batch")
        .agg(F.sort_array(F.collect_list(F.struct("_place", "_item"))).alias("_rows"))
    )
    items = F.transform("_rows", lambda row: row["_item"])
    return batches.select(
        "bucket",
        "batch",
        F.transform("_rows", lambda row: row["_item"]["id"]).alias("ids"),
        F.to_json(items, {"ignoreNullFields": "false"}).alias("items"),
    )


def render_classify_prompt(
    items: Column,
    categories: Sequence[str] = fv.CATEGORIES,
    template: str | None = None,
) -> Column:
    """Prompt of one batch. `template` has the slots {categories} and {items}."""
    template = template if template is not None else _PROMPT + "{items}"
    before, slot, after = template.partition("{items}")
    if not slot:
        raise ValueError("the template needs the slot {items}")
    names = ", ".join(categories)
    return F.concat(
        F.lit(before.replace("{categories}", names)),
        items,
        F.lit(after.replace("{categories}", names)),
    )


def _ask(
    model: TextModel, prompt: str, items: str, attempts: int, pause: float
) -> dict:
    """Empty answers, errors and JSON without labels are tried again, broken JSON is not."""
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause)
        try:
            response = model(prompt, items)
        except Exception:
            continue
        if not response:
            continue
        try:
            labels = json.loads(response)
        except ValueError:
            return {"response": response, "status": fv.JSON_PARSE_ERROR}
        if isinstance(labels, list) or isinstance(labels, dict) and {"id", "category"} <= labels.keys():
            return {"response": response, "status": "ok"}
    return {"response": None, "status": fv.API_ERROR}


def classify_batches(
    batches: DataFrame,
    provider: Callable[[], TextModel],
    attempts: int = fv.ATTEMPTS,
    pause: float = fv.PAUSE_SECONDS,
    parallelism: int | None = None,
    log: ResponseLog | None = None,
) -> DataFrame:
    """Call the model once per batch: adds `response` and `status`.

    `batches` has the columns of `make_batches` plus `prompt`. `parallelism` spreads the
    calls over that many tasks, by default as many as a shuffle has. A task that Spark
    repeats repeats its calls, so store the result before joining it
    (`session.materialize`). With a `log`, batches whose answer is there are not asked.
    """
    ask = partial(_ask, attempts=attempts, pause=pause)

    def replies(asked: DataFrame) -> DataFrame:
        keys = [c for c in ("bucket", "batch") if c in asked.columns]
        asked = spread(asked, parallelism, *keys)
        reply = model_call(ask, provider)(F.col("prompt"), F.col("items"))
        return asked.withColumn("_reply", reply).select(*asked.columns, "_reply.response", "_reply.status")

    if log is None:
        answered = replies(batches)
    else:
        answered = logged(
            batches, log, ("prompt", "items"), replies, ("response", "status"), F.col("status") == "ok"
        )
    return answered.select("bucket", "batch", "ids", "response", "status")


def explode_classified(responses: DataFrame) -> DataFrame:
    """`id, category, bucket, batch, place`: one row per result; a failed batch gives
    its label to all of its ids."""
    answered = F.from_json("response", f"array<{schemas.CLASSIFIED}>")
    failed = F.transform(
        "ids", lambda i: F.struct(i.alias("id"), F.col("status").alias("category"))
    )
    rows = responses.select(
        "bucket",
        "batch",
        F.posexplode(F.when(F.col("status") == "ok", answered).otherwise(failed)).alias("place", "_row"),
    )
    return rows.select("_row.id", "_row.category", "bucket", "batch", "place")


def join_back(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Results with their article's columns. Unknown ids and unanswered articles drop out."""
    return articles.join(results, F.col("news_id") == F.col("id")).drop("id")


def classify_articles(
    articles: DataFrame,
    provider: Callable[[], TextModel],
    categories: Sequence[str] = fv.CATEGORIES,
    size: int = fv.BATCH_SIZE,
    buckets: int | None = None,
    attempts: int = fv.ATTEMPTS,
    pause: float = fv.PAUSE_SECONDS,
    parallelism: int | None = None,
    log: ResponseLog | None = None,
) -> DataFrame:
    """Batches through the model and back to rows, as one plan."""
    batches = make_batches(articles, size, buckets)
    prompts = batches.withColumn("prompt", render_classify_prompt(F.col("items"), categories))
    return explode_classified(classify_batches(prompts, provider, attempts, pause, parallelism, log))
