"""Counts of articles by category and publisher over a range of days."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom import fixed_values as fv
from newsloom.functions.dates import date_bounds

Day = dt.date | str | None


def in_range(metadata: DataFrame, start: Day = None, end: Day = None, today: Day = None) -> DataFrame:
    """Rows published from `start` to `end`; rows without a date are in no range."""
    return metadata.where(date_bounds(F.col("published_at"), start, end, today))


def ranked_names(counted: DataFrame, by: str, limit: int) -> DataFrame:
    """The most frequent of some counted names; ties by name, the missing one last."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return counted.orderBy(F.desc("count"), F.asc_nulls_last(by)).limit(limit)


def _top(metadata: DataFrame, by: str, limit: int, *days: Day) -> DataFrame:
    counted = in_range(metadata, *days).groupBy(by).agg(F.count("news_id").alias("count"))
    return ranked_names(counted, by, limit)


def top_categories(
    metadata: DataFrame, start: Day = None, end: Day = None, limit: int = fv.TREND_LIMIT, today: Day = None
) -> DataFrame:
    """`category, count` of the most frequent categories; ties by name, the missing
    category last."""
    return _top(metadata, "category", limit, start, end, today)


def top_publishers(
    metadata: DataFrame, start: Day = None, end: Day = None, limit: int = fv.TREND_LIMIT, today: Day = None
) -> DataFrame:
    """`publisher, count` of the most frequent publishers, ordered as `top_categories`."""
    return _top(metadata, "publisher", limit, start, end, today)


def total_in_range(
    metadata: DataFrame, start: Day = None, end: Day = None, today: Day = None
) -> DataFrame:
    """`total` rows in the range."""
    return in_range(metadata, start, end, today).agg(F.count("id").alias("total"))


class TrendReport(NamedTuple):
    categories: DataFrame
    publishers: DataFrame
    summary: DataFrame


def trend_table(
    metadata: DataFrame, start: Day = None, end: Day = None, limit: int = fv.TREND_LIMIT, today: Day = None
) -> DataFrame:
    """The whole report from one scan: `kind, name, count, rank`, where kind is category,
    publisher or total.

    Both groupings and the total are one aggregate over grouping sets, combined before
    the shuffle; each task passes on at most `limit` names per kind to the ranking.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    counted = (
        in_range(metadata, start, end, today)
        .groupingSets(
            [[F.col("category")], [F.col("publisher")], []], F.col("category"), F.col("publisher")
        )
        .agg(
            F.grouping_id().alias("_set"),
            F.count("news_id").alias("_articles"),
            F.count("id").alias("_rows"),
        )
    )
    # grouping_id: bit 1 is set where category, bit 0 where publisher is aggregated away.
    kind = F.when(F.col("_set") == 1, "category").when(F.col("_set") == 2, "publisher").otherwise("total")
    named = counted.select(
        kind.alias("kind"),
        F.when(kind == "category", F.col("category")).when(kind == "publisher", F.col("publisher")).alias("name"),
        F.when(kind == "total", F.col("_rows")).otherwise(F.col("_articles")).alias("count"),
    )
    window = Window.partitionBy("kind").orderBy(F.desc("count"), F.asc_nulls_last("name"))
    return named.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def trend_sentence(total: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """`total, sentence`: the total and the days asked for."""
    days = [F.lit(fv.ALL_TIME if day is None else str(day)[:10]) for day in (start, end)]
    return total.select("total", F.format_string(fv.TREND_SENTENCE, F.col("total"), *days).alias("sentence"))


def trend_report(
    metadata: DataFrame, start: Day = None, end: Day = None, limit: int = fv.TREND_LIMIT, today: Day = None
) -> TrendReport:
    """Both top lists, and one sentence with the total and the days asked for."""
    return TrendReport(
        top_categories(metadata, start, end, limit, today),
        top_publishers(metadata, start, end, limit, today),
        trend_sentence(total_in_range(metadata, start, end, today), start, end),
    )
