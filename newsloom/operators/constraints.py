"""Table constraints, which Parquet does not enforce, as rows of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv


def _rows(df: DataFrame, name: Column, key: str, count: Column) -> DataFrame:
    return df.select(
        name.alias("violation"),
        F.col(key).cast("string").alias("key"),
        count.cast("bigint").alias("rows"),
    )


def _counted(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per key, so that a frequent key is one row in the joins that follow."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(name))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )


def check_constraints(
    raw: DataFrame,
    metadata: DataFrame,
    chunks: DataFrame,
    dim: int = fv.EMBEDDING_DIM,
    categories: Sequence[str] = fv.CATEGORIES,
) -> DataFrame:
    """`violation, key, rows`: repeated metadata keys, missing parents, vectors of the
    wrong length, and categories outside the taxonomy."""
    known = raw.select(F.col("id").alias("_article"))
    per_article = _counted(metadata, "news_id", "_id").join(
        known.distinct(), F.col("_id") == F.col("_article"), "left"
    )
    broken = F.array_compact(
        F.array(
            F.when(F.col("_rows") > 1, "metadata.news_id repeated"),
            F.when(F.col("_article").isNull(), "metadata.news_id without article"),
        )
    )
    keys = per_article.select("_id", "_rows", F.explode(broken).alias("_name"))

    parents = metadata.select(F.col("news_id").alias("_parent")).distinct()
    orphans = _counted(chunks, "news_id", "_id").join(
        parents, F.col("_id") == F.col("_parent"), "left_anti"
    )
    wrong = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim))
    outside = (
        metadata.where(F.col("category").isNull() | ~F.col("category").isin(*categories))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return (
        _rows(keys, F.col("_name"), "_id", F.col("_rows"))
        .unionByName(_rows(orphans, F.lit("chunk.news_id without metadata"), "_id", F.col("_rows")))
        .unionByName(_rows(wrong, F.lit("chunk.embedding length"), "id", F.lit(1)))
        .unionByName(
            _rows(outside, F.lit("metadata.category outside taxonomy"), "category", F.col("_rows"))
        )
    )
