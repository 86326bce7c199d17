"""Prompts, model answers and their rendering, one row per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom import schemas
from newsloom.functions.models import model_call, spread
from newsloom.operators.responses import ResponseLog, logged
from newsloom.providers import TextModel

_PROMPT = (
    "Answer the question from the articles below and from nothing else, in at most 200 characters. "
    "If they do not answer it, say so. Reply with a JSON object: summary, a string, and references, "
    "an array of objects with news_id, title and publisher of each article used.\n"
    "Question: {query}\nArticles, most relevant first: {results}"
)


def context_json(results: Column) -> Column:
    """Context items as a JSON array. Stored metadata is JSON already and goes in as it
    is; similarity is written with six digits."""

    def item(hit: Column) -> Column:
        head = F.to_json(
            F.struct(
                hit["news_id"].alias("news_id"),
                F.round(hit["similarity"], 6).cast("decimal(9,6)").alias("similarity"),
                hit["chunk_text"].alias("chunk_text"),
                hit["full_article"].alias("full_article"),
                hit["link"].alias("link"),
            ),
            {"ignoreNullFields": "false"},
        )
        return F.concat(
            F.left(head, F.length(head) - 1),
            F.lit(',"meta_data":'),
            F.coalesce(hit["meta_data"], F.lit("null")),
            F.lit("}"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform(results, item), ","), F.lit("]"))


def render_answer_prompt(query: Column, context: Column, template: str = _PROMPT) -> Column:
    """Prompt of one query. `template` has the slots {query} and {results}, in this order."""
    before, query_slot, rest = template.partition("{query}")
    between, results_slot, after = rest.partition("{results}")
    if not (query_slot and results_slot):
        raise ValueError("the template needs the slots {query} and {results}")
    return F.concat(F.lit(before), query, F.lit(between), context, F.lit(after))


def generate_answers(
    prompts: DataFrame,
    provider: Callable[[], TextModel],
    parallelism: int | None = None,
    log: ResponseLog | None = None,
) -> DataFrame:
    """Add `response, status` from one call per row of `prompt, context`, without a retry.

    Status is ok, empty or error, and null where the prompt is null: no call is made
    then. Only prompt and context go to Python. `parallelism` spreads the calls over
    that many tasks, by default as many as a shuffle has. With a `log`, prompts whose answer
    is there are not asked.
    """

    def ask(model: TextModel, prompt: str | None, context: str | None) -> dict:
        if prompt is None:
            return {"response": None, "status": None}
        try:
            response = model(prompt, context)
        except Exception:
            return {"response": None, "status": "error"}
        return {"response": response or None, "status": "ok" if response else "empty"}

    def replies(asked: DataFrame) -> DataFrame:
        reply = model_call(ask, provider)(F.col("prompt"), F.col("context"))
        return spread(asked, parallelism).withColumn("_reply", reply).select(
            *asked.columns, "_reply.response", "_reply.status"
        )

    if log is None:
        return replies(prompts)
    return logged(
        prompts, log, ("prompt", "context"), replies, ("response", "status"), F.col("status") == "ok"
    )


def _no_references() -> Column:
    return F.array().cast(f"array<{schemas.REFERENCE}>")


def parse_answer(response: Column, status: Column) -> Column:
    """`struct<summary, references, status>`. A response that is no JSON object, an empty
    one and a failed call each give their fixed text and no references. Fields of another
    type than expected do not spoil an answer: ids may be text, the rest is null."""
    text = F.when(F.ltrim(response).startswith("{"), response)
    parsed = F.from_json(
        text, "summary string, references array<struct<news_id: string, title: string, publisher: string>>"
    )
    references = F.transform(
        F.filter(parsed["references"], lambda r: r.isNotNull()),
        lambda r: F.struct(
            r["news_id"].try_cast("bigint").alias("news_id"), r["title"].alias("title"), r["publisher"].alias("publisher")
        ),
    )
    good = (status == "ok") & F.try_parse_json(text).isNotNull()
    outcome = F.when(status != "ok", status).when(good, F.lit("ok")).otherwise(F.lit("bad_json"))
    return F.struct(
        F.when(status == "empty", F.lit(fv.EMPTY_ANSWER_SUMMARY))
        .when(status == "error", F.lit(fv.CALL_ERROR_SUMMARY))
        .when(good, parsed["summary"])
        .otherwise(F.lit(fv.BAD_JSON_SUMMARY))
        .alias("summary"),
        F.coalesce(F.when(good, references), _no_references()).alias("references"),
        outcome.alias("status"),
    )


def no_hits_answer() -> Column:
    """The answer to a query without any hit."""
    return F.struct(
        F.lit(fv.NO_HITS_SUMMARY).alias("summary"),
        _no_references().alias("references"),
        F.lit("no_hits").alias("status"),
    )


def resolve_references(references: Column, results: Column) -> Column:
    """References with the link of the hit they name, within the row: `array<struct<
    news_id, title, publisher, link>>`. Of several hits the last with a link counts."""

    def resolve(reference: Column) -> Column:
        linked = F.filter(
            results,
            lambda hit: (hit["news_id"] == reference["news_id"]) & (hit["link"] != ""),
        )
        return F.struct(
            reference["news_id"].alias("news_id"),
            F.coalesce(reference["title"], F.lit(fv.UNKNOWN_TITLE)).alias("title"),
            F.coalesce(reference["publisher"], F.lit(fv.UNKNOWN_PUBLISHER)).alias("publisher"),
            F.coalesce(F.try_element_at(linked, F.lit(-1))["link"], F.lit(fv.UNKNOWN_LINK)).alias("link"),
        )

    return F.transform(references, resolve)


def render_answer(summary: Column, resolved: Column) -> Column:
    """The answer as Markdown: the summary, then one line per resolved reference."""
    lines = F.transform(
        resolved,
        lambda r: F.format_string("- [%s](%s) - %s\n", r["title"], r["link"], r["publisher"]),
    )
    body = F.coalesce(summary, F.lit(fv.NO_HITS_SUMMARY))
    return F.when(F.size(resolved) == 0, body).otherwise(
        F.concat(body, F.lit(fv.REFERENCE_HEADING), F.array_join(lines, ""))
    )
