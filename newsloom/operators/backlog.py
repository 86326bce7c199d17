"""Articles still to be classified or embedded.

Selection runs on keys and dates alone; article text is read afterwards, with
the few selected ids, so it is never shuffled behind a limit. Without one it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.dates import stringify_timestamp
from newsloom.functions.sizes import LITERAL_IDS, broadcast_ids, with_ids


def _without(rows: DataFrame, key: str, done: DataFrame, null_aware: bool) -> DataFrame:
    """Rows whose key is not in `done.news_id`. `null_aware` is SQL's NOT IN: one null
    among the ids leaves nothing, and neither does a null key unless `done` is empty."""
    ids = done.select(F.col("news_id").alias("_done"))
    left = rows.join(ids.distinct(), F.col(key) == F.col("_done"), "left_anti")
    if not null_aware:
        return left
    if ids.where("_done IS NULL").limit(1).count():
        return left.limit(0)
    return left.where(F.col(key).isNotNull()) if ids.limit(1).count() else left


def _few(rows: DataFrame, ids: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """Rows whose key is in `ids`, at most `limit` of them: as literals while they are few,
    so that they reach the Parquet reader, else by a join."""
    if limit <= LITERAL_IDS:
        return with_ids(rows, key, [r[0] for r in ids.collect()])
    return rows.join(broadcast_ids(ids, limit), key, "left_semi")


def _check(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")


def unclassified_backlog(
    raw: DataFrame,
    metadata: DataFrame,
    limit: int | None = fv.CLASSIFY_LIMIT,
    null_aware: bool = False,
) -> DataFrame:
    """`news_id, title, published_at, publisher, summary` of articles without metadata.

    The newest `limit` of them, undated ones first, ties by id; all of them, in no
    order, for None. The date is returned as text.
    """
    _check(limit)
    if limit is None:
        rows = _without(raw, "id", metadata, null_aware)
    else:
        newest_first = (F.desc_nulls_first("published_at"), F.col("id"))
        newest = (
            _without(raw.select("id", "published_at"), "id", metadata, null_aware)
            .orderBy(*newest_first)
            .limit(limit)
            .select("id")
        )
        rows = _few(raw, newest, limit)
        rows = rows.orderBy(*newest_first).limit(limit)
    return rows.select(
        F.col("id").alias("news_id"),
        "title",
        stringify_timestamp(F.col("published_at")).alias("published_at"),
        "publisher",
        "summary",
    )


def unembedded_backlog(
    raw: DataFrame,
    metadata: DataFrame,
    chunks: DataFrame,
    limit: int | None = fv.EMBED_LIMIT,
    require_metadata: bool = True,
    null_aware: bool = False,
) -> DataFrame:
    """`news_id, content, title, published_at, publisher, category` of articles without
    chunks, the lowest `limit` ids in order; all of them, in no order, for None.

    Unclassified articles are left out unless `require_metadata` is off, because their
    chunks could not refer to metadata. The date is returned as text.
    """
    _check(limit)
    facts = metadata.select(
        F.col("news_id").alias("_classified"), "title", "published_at", "publisher", "category"
    )
    articles = raw.select("id", "content")
    if limit is None:
        articles = _without(articles, "id", chunks, null_aware)
    else:
        ids = _without(raw.select("id"), "id", chunks, null_aware)
        if require_metadata:
            known = metadata.select(F.col("news_id").alias("_classified")).distinct()
            ids = ids.join(known, F.col("id") == F.col("_classified"), "left_semi")
        ids = ids.orderBy("id").limit(limit)
        if limit <= LITERAL_IDS:
            ids = ids.sparkSession.createDataFrame(ids.collect(), ids.schema)
        articles = _few(articles, ids, limit)
        facts = _few(facts, ids.withColumnRenamed("id", "_classified"), limit, "_classified")
    how = "inner" if require_metadata else "left"
    rows = articles.join(facts, F.col("id") == F.col("_classified"), how)
    if limit is not None:
        rows = rows.orderBy("id", *facts.columns[1:]).limit(limit)
    return rows.select(
        F.col("id").alias("news_id"),
        "content",
        "title",
        stringify_timestamp(F.col("published_at")).alias("published_at"),
        "publisher",
        "category",
    )
