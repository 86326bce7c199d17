"""Articles to chunks: row-local, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.text import split_sentences, with_chunks

_BASE = ("news_id", "title", "published_at", "publisher", "category")


def chunk_articles(
    articles: DataFrame,
    max_length: int = fv.MAX_LENGTH,
    overlap: int = fv.OVERLAP,
    delimiters: str = fv.SENTENCE_DELIMITERS,
    terminator: str = fv.SENTENCE_TERMINATOR,
) -> DataFrame:
    """One row per chunk: the article's columns without `content`, plus `chunk_idx,
    chunk_text, status`.

    An article without any sentence gives one marker row: no text, status `no_content`.
    """
    marker = F.array(F.lit(None).cast("string"))
    # A null content leaves the size null, which the second branch catches.
    texts = F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(marker)
    rest = [c for c in articles.columns if c != "content"]
    sentences = split_sentences(F.col("content"), delimiters)
    return (
        with_chunks(articles, sentences, "_chunks", max_length, overlap, terminator)
        .select(*rest, F.posexplode(texts).alias("chunk_idx", "chunk_text"))
        .withColumn("status", F.when(F.col("chunk_text").isNull(), F.lit(fv.NO_CONTENT)))
    )


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """`news_id, chunk_text, metadata`: the remaining columns as JSON text. Null facts
    are written as null; `status` is there on marker rows only."""
    keep = {"ignoreNullFields": "false"}
    fields = [*_BASE, "chunk_idx"]
    text = F.when(F.col("status").isNull(), F.to_json(F.struct(*fields), keep)).otherwise(
        F.to_json(F.struct(*fields, "status"), keep)
    )
    return chunks.select("news_id", "chunk_text", text.alias("metadata"))
