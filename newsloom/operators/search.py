"""Exact nearest-chunk search, and what is attached to its hits.

A search scans the vectors once. Every task keeps the best k of each query while it
reads, so k rows per query and task are shuffled, never a score per chunk. Only ids and
scores take part; text and links are read afterwards for the rows that were hit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom import fixed_values as fv
from newsloom.functions import vectors
from newsloom.functions.sizes import BROADCAST_BYTES, LITERAL_IDS, broadcast_ids, measure, with_ids

# Bytes per side of a block when queries are too many to send everywhere.
_QUERY_BLOCK_BYTES = 256 * 1024 * 1024
_VECTOR_BLOCK_BYTES = 64 * 1024 * 1024


def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def _vectors(chunks: DataFrame) -> DataFrame:
    """Chunks that can be hits: they have an id and a vector."""
    return chunks.where("id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("id").cast("bigint"),
        F.col("news_id").cast("bigint"),
        F.col("embedding").cast("array<float>"),
    )


def _scan(chunks: DataFrame, query_ids: Sequence[int], queries: np.ndarray, k: int) -> DataFrame:
    return _vectors(chunks).mapInArrow(
        vectors.top_k_scan(query_ids, queries, k), vectors.TOP_K_SCHEMA
    )


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    """Best k of the per-task candidates. The shuffle by query is what makes the scan
    above it run once, however often the hits are used in one plan."""
    window = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    # Written out, so that joins on these columns add no filter that sets the uses apart.
    partial = partial.where("query_id IS NOT NULL AND id IS NOT NULL")
    return partial.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def nearest(chunks: DataFrame, query: Sequence[float], k: int = fv.TOP_K) -> DataFrame:
    """`id, news_id, similarity, rank` of the k chunks nearest to one vector."""
    _check_k(k)
    partial = _scan(chunks, [0], np.asarray([query], dtype=np.float32), k)
    return _ranked(partial, k).drop("query_id")


def nearest_batch(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = fv.TOP_K,
    max_query_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`query_id, id, news_id, similarity, rank` of the k chunks nearest to every query
    vector.

    The queries (`query_id, embedding`) are measured: while they fit they travel to the
    tasks that scan the chunks; beyond that both tables are cut into blocks and joined
    block by block. Both ways give the same rows.
    """
    return _nearest_batch(chunks, queries, k, max_query_bytes)[0]


def _nearest_batch(chunks, queries, k, max_query_bytes) -> tuple[DataFrame, int]:
    _check_k(k)
    asked = queries.where(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("bigint"), F.col("embedding").cast("array<float>")
    )
    count, size = measure(asked)
    if count == 0:
        partial = chunks.sparkSession.createDataFrame([], vectors.TOP_K_SCHEMA)
    elif size > max_query_bytes:
        partial = _blocks(chunks, asked, count, size, k)
    else:
        table = asked.toArrow()
        partial = _scan(
            chunks, table.column("query_id").to_numpy(), vectors.matrix(table.column("embedding")), k
        )
    return _ranked(partial, k), count * k


def _blocks(chunks: DataFrame, asked: DataFrame, count: int, size: int, k: int) -> DataFrame:
    """Candidates of every (vector block, query block) pair.

    Blocks are hashed from unique ids, so none is larger than the others, and their
    number follows from the table sizes, so each fits in one task.
    """
    stored = _vectors(chunks)
    query_blocks = -(-size // _QUERY_BLOCK_BYTES)
    # All vectors have one length, so queries tell the bytes per stored row as well.
    vector_blocks = max(-(-stored.count() * size // (count * _VECTOR_BLOCK_BYTES)), 1)

    def own(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = stored.select(
        "*", own("id", vector_blocks).alias("vector_block"), every(query_blocks).alias("query_block")
    )
    right = asked.select(
        "*", own("query_id", query_blocks).alias("query_block"), every(vector_blocks).alias("vector_block")
    )

    def score(rows: pa.Table, asking: pa.Table) -> pa.Table:
        if not rows.num_rows or not asking.num_rows:
            top = vectors.TopK([], np.empty((0, 1)), k)
        else:
            queries = vectors.matrix(asking.column("embedding"))
            top = vectors.TopK(asking.column("query_id").to_numpy(), queries, k)
            for batch in rows.select(["id", "news_id", "embedding"]).to_batches(8192):
                top.add(*batch.columns)
        return pa.Table.from_batches([top.result()])

    keys = ["vector_block", "query_block"]
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, vectors.TOP_K_SCHEMA)
    )


def attach_chunks(hits: DataFrame, chunks: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Add the `chunk_text` and `metadata` of hits, from one scan without vectors.

    Hand it hits of ids and numbers only: `max_hits` bounds what is broadcast.
    """
    facts = [c for c in ("chunk_text", "metadata") if c in chunks.columns]
    texts = chunks.select(F.col("id").alias("_chunk"), *facts)
    small = broadcast_ids(hits, max_hits)
    return texts.join(small, F.col("_chunk") == F.col("id")).select(*hits.columns, *facts)


def _articles_of(
    hits: DataFrame, raw: DataFrame, column: str, max_hits: int | None, key: str = "news_id"
) -> DataFrame:
    """`_article` and one column of the articles in `hits`, before hits and articles meet."""
    wanted = hits.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()
    return (
        raw.select("id", column)
        .join(broadcast_ids(wanted, max_hits), "id", "left_semi")
        .select(F.col("id").alias("_article"), F.col(column).alias(f"_{column}"))
    )


def attach_links(
    hits: DataFrame, raw: DataFrame, max_hits: int | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Add the article's `link`; null for an article that is not stored.

    `ids` may name the same articles from an earlier, cheaper stage of the plan.
    """
    links = _articles_of(hits if ids is None else ids, raw, "link", max_hits)
    return (
        hits.join(links, F.col("news_id") == F.col("_article"), "left")
        .withColumnRenamed("_link", "link")
        .drop("_article")
    )


_HIT = ("query_id", "rank", "id", "news_id", "similarity", "chunk_text", "link", "metadata")


def hit_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in _HIT if c in df.columns])


def search_top_k(
    chunks: DataFrame, raw: DataFrame, query: Sequence[float], k: int = fv.TOP_K
) -> DataFrame:
    """The k chunks most similar to a query vector, best first: `rank, id, news_id,
    similarity, chunk_text, link, metadata`.

    Chunks without an id or a vector are no hits; ties go to the lower id; a zero vector, or
    one with a missing, undefined or endless element, has no similarity and comes last.
    """
    hits = nearest(chunks, query, k)
    if k <= LITERAL_IDS:
        # the hits themselves, so that their ids reach the Parquet reader
        rows = hits.collect()
        hits = chunks.sparkSession.createDataFrame(rows, hits.schema)
        chunks = with_ids(chunks, "id", [r["id"] for r in rows])
        raw = with_ids(raw, "id", [r["news_id"] for r in rows])
    found = attach_links(attach_chunks(hits, chunks, k), raw, k, ids=hits)
    return hit_columns(found).orderBy("rank").limit(k)


def search_top_k_batch(
    chunks: DataFrame,
    raw: DataFrame,
    queries: DataFrame,
    k: int = fv.TOP_K,
    max_query_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`search_top_k` for a table of queries (`query_id, embedding`): adds `query_id`."""
    hits, max_hits = _nearest_batch(chunks, queries, k, max_query_bytes)
    return hit_columns(attach_links(attach_chunks(hits, chunks, max_hits), raw, max_hits, ids=hits))


def _mark_wanted(hits: DataFrame, max_articles: int) -> DataFrame:
    """Add `_wanted`: the article id where the query's hits cover few articles."""
    per_query = Window.partitionBy("query_id")
    articles = F.size(F.collect_set("news_id").over(per_query))
    unknown = F.max(F.col("news_id").isNull().cast("int")).over(per_query)
    few = articles + unknown <= max_articles
    return hits.withColumn("_wanted", F.when(few, F.col("news_id")))


def enrich_full_article(
    hits: DataFrame,
    raw: DataFrame,
    max_articles: int = fv.MAX_FULL_ARTICLES,
    max_hits: int | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Add `full_article`: the article text where a query's hits cover at most
    `max_articles` articles, otherwise, or if it is missing, `''`.

    `hits` has `query_id` and `news_id`, at most k rows per query. `ids` may be the same
    hits from an earlier, cheaper stage of the plan. Apply it last: texts are large.
    """
    marked = _mark_wanted(hits, max_articles)
    wanted = marked if ids is None else _mark_wanted(ids, max_articles)
    texts = _articles_of(wanted, raw, "content", max_hits, key="_wanted")
    return (
        marked.join(texts, F.col("_wanted") == F.col("_article"), "left")
        .withColumn("full_article", F.coalesce("_content", F.lit("")))
        .drop("_wanted", "_article", "_content")
    )


def build_context(hits: DataFrame) -> DataFrame:
    """`query_id, results`: the hits of every query in order of rank, as an array of
    structs with six fields."""
    fields = F.struct(
        "rank",
        "news_id",
        "similarity",
        "chunk_text",
        "full_article",
        F.col("metadata").alias("meta_data"),
        "link",
    )
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(fields)).alias("_hits"))
    return ranked.select(
        "query_id", F.transform("_hits", lambda hit: hit.dropFields("rank")).alias("results")
    )


def metadata_filter(
    metadata: DataFrame,
    category: str | None = None,
    publisher: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> DataFrame:
    """Rows that match every condition given; both dates are inclusive moments."""
    found = metadata
    if category is not None:
        found = found.where(F.col("category") == category)
    if publisher is not None:
        found = found.where(F.col("publisher") == publisher)
    if start is not None:
        found = found.where(F.col("published_at") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        found = found.where(F.col("published_at") <= F.lit(str(end)).cast("timestamp_ntz"))
    return found


def metadata_search(
    metadata: DataFrame,
    raw: DataFrame,
    category: str | None = None,
    publisher: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(`total_count`, rows of `title, publisher, link`) of the articles that match
    every condition given; both dates are inclusive moments."""
    found = metadata_filter(metadata, category, publisher, start, end)
    links = raw.select(F.col("id").alias("_article"), "link")
    rows = found.join(links, F.col("news_id") == F.col("_article"), "left").select(
        "title", "publisher", "link"
    )
    return found.agg(F.count(F.lit(1)).alias("total_count")), rows
