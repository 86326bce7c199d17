"""The scheduled steps and the question-answering job, as whole Spark plans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.sizes import broadcast_if_small
from newsloom.operators import answer, backlog, chunk, classify, embed, search
from newsloom.operators.extract import extract_pages
from newsloom.operators.responses import ResponseLog
from newsloom.operators.retries import Retries, due, failed_now, settled
from newsloom.operators.upsert import unseen
from newsloom.providers import Embedder, TextModel
from newsloom.schemas import CONTEXT
from newsloom.session import discard, materialize
from newsloom.sinks import append, insert_if_absent
from newsloom.sources.feed import attach_pages
from newsloom.sources.tables import read_if_present, read_table


def ingest_batch(
    feed: DataFrame,
    pages: DataFrame,
    raw: str,
    page_order: str | None = None,
    extract: Callable[[DataFrame], DataFrame] = extract_pages,
) -> int:
    """Append the feed entries whose link is not in the table `raw`, with publisher and
    content of their pages; returns the rows appended.

    Stored links are dropped first, and only the pages of the remaining ones are parsed.
    """
    stored = read_if_present(feed.sparkSession, raw)
    landed = materialize(feed, "landed")
    fresh = landed if stored is None else materialize(unseen(landed, stored, "link"), "fresh")
    try:
        links = fresh.select(F.col("link").alias("url")).where("url IS NOT NULL").distinct()
        found = pages.join(broadcast_if_small(links), "url", "left_semi")
        return append(attach_pages(fresh, extract(found), page_order), raw, id_col="id", key="link")
    finally:
        discard(*{id(copy): copy for copy in (landed, fresh)}.values())


def classify_step(
    spark: SparkSession,
    raw: str,
    metadata: str,
    provider: Callable[[], TextModel],
    limit: int | None = fv.CLASSIFY_LIMIT,
    categories: Sequence[str] = fv.CATEGORIES,
    size: int = fv.BATCH_SIZE,
    attempts: int = fv.ATTEMPTS,
    pause: float = fv.PAUSE_SECONDS,
    parallelism: int | None = None,
    skip_failed: bool = False,
    log: ResponseLog | None = None,
    retries: Retries | None = None,
    now: dt.datetime | None = None,
) -> int:
    """Classify the articles without metadata and store the results; returns the rows
    inserted. Running it again inserts nothing new.

    The selection and the model's responses are written once, so that no call is
    repeated by a later stage or a lost executor. With a `log`, neither are the calls of
    earlier runs. With `retries`, articles that failed are left until they are due, and their
    failure is stored after the last attempt; without, it is stored at once, or never with
    `skip_failed`. `now` is the moment of the run.
    """
    now = now or dt.datetime.now()
    articles = read_table(spark, raw)
    if retries is not None:
        articles = due(articles.withColumn("news_id", F.col("id")), retries, now).drop("news_id")
    waiting = materialize(
        backlog.unclassified_backlog(articles, read_table(spark, metadata), limit),
        "backlog",
    )
    copies = [waiting]
    try:
        results = materialize(
            classify.classify_articles(
                waiting, provider, categories, size, None, attempts, pause, parallelism, log
            ),
            "classified",
        )
        copies.append(results)
        rows = classify.join_back(results, waiting)
        if retries is not None:
            # what fails for good is stored before it is counted, so that a lost run counts less, not more
            rows = settled(rows, retries)
            stored = insert_if_absent(rows, metadata, "news_id", ("bucket", "batch", "place"), id_col="id")
            append(failed_now(classify.join_back(results, waiting), now), retries.journal)
            return stored
        return insert_if_absent(
            rows,
            metadata,
            "news_id",
            ("bucket", "batch", "place"),
            id_col="id",
            skip_failed=skip_failed,
        )
    finally:
        discard(*copies)


def embed_step(
    spark: SparkSession,
    raw: str,
    metadata: str,
    chunks: str,
    provider: Callable[[], Embedder],
    limit: int | None = fv.EMBED_LIMIT,
    max_length: int = fv.MAX_LENGTH,
    overlap: int = fv.OVERLAP,
    delimiters: str = fv.SENTENCE_DELIMITERS,
    terminator: str = fv.SENTENCE_TERMINATOR,
    parallelism: int | None = None,
    require_metadata: bool = True,
    fail_fast: bool = False,
    dim: int | None = None,
    log: ResponseLog | None = None,
) -> int:
    """Chunk and embed the articles without chunks and store the rows; returns their
    number. The write is committed whole, so a failed run is simply run again."""
    waiting = backlog.unembedded_backlog(
        read_table(spark, raw),
        read_table(spark, metadata),
        read_table(spark, chunks),
        limit,
        require_metadata,
    )
    pieces = chunk.chunk_metadata(
        chunk.chunk_articles(waiting, max_length, overlap, delimiters, terminator)
    )
    vectors = embed.embed_chunks(pieces, provider, parallelism=parallelism, fail_fast=fail_fast, dim=dim, log=log)
    return append(vectors, chunks, id_col="id")


def answer_queries(
    queries: DataFrame,
    chunks: DataFrame,
    raw: DataFrame,
    embedder: Callable[[], Embedder],
    model: Callable[[], TextModel],
    k: int = fv.TOP_K,
    max_articles: int = fv.MAX_FULL_ARTICLES,
    parallelism: int | None = None,
    log: ResponseLog | None = None,
) -> DataFrame:
    """`query_id, query, results, answer, text` for a table of `query_id, query`.

    Queries without a hit get the fixed answer and cause no model call. The result reads
    the stored answers in the shared folder.
    """
    asked = materialize(embed.embed_queries(queries.select("query_id", "query"), embedder), "queries")
    hits = materialize(search.search_top_k_batch(chunks, raw, asked, k), "hits")
    context = search.build_context(search.enrich_full_article(hits, raw, max_articles))
    prompts = (
        asked.select("query_id", "query")
        .join(context, "query_id", "left")
        .withColumn("context", answer.context_json(F.col("results")))
        .withColumn("prompt", answer.render_answer_prompt(F.col("query"), F.col("context")))
    )
    answered = materialize(
        answer.generate_answers(prompts, model, parallelism, log).drop("prompt", "context"), "answers"
    )
    discard(asked, hits)
    return answered.select(
        "query_id",
        "query",
        F.coalesce("results", F.array().cast(CONTEXT)).alias("results"),
        F.when(F.col("results").isNull(), answer.no_hits_answer())
        .otherwise(answer.parse_answer(F.col("response"), F.col("status")))
        .alias("answer"),
    ).withColumn(
        "text",
        answer.render_answer(
            F.col("answer.summary"),
            answer.resolve_references(F.col("answer.references"), F.col("results")),
        ),
    )
