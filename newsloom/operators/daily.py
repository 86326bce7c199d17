"""Counts by day, category and publisher, kept up as articles come in and change.

The table holds additions: every batch writes what it adds to each day, a change writes what
it takes away and what it adds. Sums over the additions of a range of days are the counts of
the articles themselves, so that a report reads days, not articles. Days are partitions; a
range that ends on whole days is a range of partitions.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.operators.analytics import Day, TrendReport, ranked_names, trend_sentence
from newsloom.session import discard, materialize

_KEYS = ("day", "category", "publisher")
#: Rows, rows with an id, and rows with an article.
_COUNTS = ("n", "ids", "articles")


def _counted(metadata: DataFrame, sign: int = 1) -> DataFrame:
    return (
        metadata.groupBy(F.to_date("published_at").alias("day"), "category", "publisher")
        .agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.count("news_id").alias("articles"))
        .select(*_KEYS, *[(sign * F.col(c)).alias(c) for c in _COUNTS])
    )


def _write(additions: DataFrame, folder: str, batch: str | None) -> None:
    named = additions.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    # a day's additions in few files
    named.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(folder)


def record(metadata: DataFrame, folder: str, batch: str | None = None) -> None:
    """Add rows of metadata to the counts of their days, however old these are. A batch that is
    named counts once, even if it is recorded again."""
    _write(_counted(metadata), folder, batch)


def record_change(old: DataFrame, new: DataFrame, folder: str, batch: str | None = None) -> None:
    """Take rows out of the counts as they were, and add them as they are now; a row that is
    gone is in `old` alone."""
    both = _counted(old, -1).unionByName(_counted(new))
    sums = both.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    _write(sums.where(" OR ".join(f"{c} <> 0" for c in _COUNTS)), folder, batch)


def _once(stored: DataFrame) -> DataFrame:
    """Additions without those of a batch that was recorded again."""
    return stored.groupBy("batch", *_KEYS).agg(*[F.max_by(c, F.abs(c)).alias(c) for c in _COUNTS])


def compact(spark: SparkSession, folder: str, before: Day = None) -> int:
    """Put the additions of each day before `before`, or of all days, together; returns the rows
    left there. Batches that may still be recorded again must not be among them."""
    stored = spark.read.parquet(folder)
    if before is not None:
        stored = stored.where(F.col("day") < F.lit(str(before)[:10]).cast("date"))
    sums = _once(stored).groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    kept = materialize(sums.withColumn("batch", F.lit(uuid.uuid4().hex)), "days")
    try:
        rows = kept.select("category", "publisher", *_COUNTS, "batch", "day").hint("rebalance", "day")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
        return kept.count()
    finally:
        discard(kept)


def days_in_range(stored: DataFrame, start: Day = None, end: Day = None, today: Day = None) -> DataFrame:
    """Additions to the days from `start` to `end`, or to today."""

    def date(day: Day) -> Column:
        return F.lit(day.isoformat()[:10] if isinstance(day, dt.date) else day).cast("date")

    last = end if end is not None else today
    inside = F.col("day") <= (F.current_date() if last is None else date(last))
    return stored.where(inside if start is None else inside & (F.col("day") >= date(start)))


def _top(stored: DataFrame, by: str, limit: int, *days: Day) -> DataFrame:
    sums = _once(days_in_range(stored, *days)).groupBy(by).agg(F.sum("articles").alias("count"), F.sum("n").alias("n"))
    return ranked_names(sums.where("n > 0").drop("n"), by, limit)


def top_categories(
    stored: DataFrame, start: Day = None, end: Day = None, limit: int = fv.TREND_LIMIT, today: Day = None
) -> DataFrame:
    """`analytics.top_categories` from the stored counts."""
    return _top(stored, "category", limit, start, end, today)


def top_publishers(
    stored: DataFrame, start: Day = None, end: Day = None, limit: int = fv.TREND_LIMIT, today: Day = None
) -> DataFrame:
    """`analytics.top_publishers` from the stored counts."""
    return _top(stored, "publisher", limit, start, end, today)


def total_in_range(stored: DataFrame, start: Day = None, end: Day = None, today: Day = None) -> DataFrame:
    """`analytics.total_in_range` from the stored counts."""
    found = _once(days_in_range(stored, start, end, today))
    return found.agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("total"))


def trend_report(
    stored: DataFrame, start: Day = None, end: Day = None, limit: int = fv.TREND_LIMIT, today: Day = None
) -> TrendReport:
    """`analytics.trend_report` from the stored counts."""
    return TrendReport(
        top_categories(stored, start, end, limit, today),
        top_publishers(stored, start, end, limit, today),
        trend_sentence(total_in_range(stored, start, end, today), start, end),
    )
