"""Counts kept by day against counts of the articles."""

import datetime as dt
import itertools

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import analytics, daily

RANGES = list(itertools.product((None, "2024-12-30", dt.date(2025, 1, 2)), (None, "2025-01-02", "2025-01-09"), (None, "2025-01-05")))


def _metadata(spark, n=400, first=0):
    def row(i):
        at = None if i % 11 == 0 else dt.datetime(2024, 12, 28) + dt.timedelta(hours=i % 400, microseconds=i)
        return (None if i % 29 == 5 else i, None if i % 13 == 1 else i, "t", at, None if i % 17 == 0 else f"p{i % 4}", None if i % 7 == 0 else f"c{i % 5}")

    return spark.createDataFrame([row(i) for i in range(first, first + n)], schemas.NEWS_METADATA)


def _same(spark, metadata, folder, ranges=RANGES):
    stored = spark.read.parquet(folder)
    for start, end, today in ranges:
        args = (start, end, 50, today)
        assert rows(daily.top_categories(stored, *args)) == rows(analytics.top_categories(metadata, *args))
        assert rows(daily.top_publishers(stored, *args)) == rows(analytics.top_publishers(metadata, *args))
        total = daily.total_in_range(stored, start, end, today).collect()
        assert total == analytics.total_in_range(metadata, start, end, today).collect()


def test_every_range(spark, tmp_path):
    folder, metadata = str(tmp_path / "daily"), _metadata(spark)
    daily.record(metadata.where("id IS NULL OR id % 2 = 0"), folder)
    daily.record(metadata.where("id % 2 = 1"), folder)
    _same(spark, metadata, folder, RANGES[::3])


def test_changes_late_rows_and_repeated_batches(spark, tmp_path):
    folder, one, two = str(tmp_path / "daily"), _metadata(spark), _metadata(spark, 60, 1000)
    daily.record(one, folder, "one")
    daily.record(one, folder, "one")
    daily.record(two, folder, "two")  # of the same days
    changed = one.withColumn("category", F.when(F.col("id") % 3 == 0, "new").otherwise(F.col("category")))
    changed = changed.withColumn("published_at", F.when(F.col("id") % 5 != 0, F.col("published_at") - F.expr("interval 2 days")))
    daily.record_change(one, changed.where("id IS NULL OR id < 300"), folder, "change")  # some rows go
    now = changed.where("id IS NULL OR id < 300").unionByName(two)
    _same(spark, now, folder, RANGES[1::5])
    left = daily.compact(spark, folder)
    assert left == spark.read.parquet(folder).count()
    _same(spark, now, folder, RANGES[2::7])
    daily.record_change(now, now.limit(0), folder)
    assert daily.top_categories(spark.read.parquet(folder)).collect() == []


def test_only_days_of_the_range_are_read(spark, tmp_path):
    folder = str(tmp_path / "daily")
    daily.record(_metadata(spark), folder)
    stored = spark.read.parquet(folder)
    inside = daily.days_in_range(stored, "2025-01-02", "2025-01-03")
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "DataFilters: []" in plan
    files = {r[0] for r in inside.select(F.input_file_name()).collect()}
    assert files and all("day=2025-01-02" in f or "day=2025-01-03" in f for f in files)


def test_report_and_limits(spark, tmp_path):
    folder, metadata = str(tmp_path / "daily"), _metadata(spark)
    daily.record(metadata, folder)
    stored = spark.read.parquet(folder)
    got, want = (m.trend_report(x, "2024-12-30", "2025-01-04", 2) for m, x in ((daily, stored), (analytics, metadata)))
    for a, b in zip(got, want):
        assert rows(a) == rows(b)
    with pytest.raises(ValueError):
        daily.top_categories(stored, limit=0)
