import datetime as dt

import pytest
from conftest import rows

from newsloom import schemas
from newsloom.operators import analytics


@pytest.fixture(scope="module")
def metadata(spark):
    def at(text):
        return None if text is None else dt.datetime.fromisoformat(text)

    data = [
        ("2025-01-01 00:00:00", "a", "p"), ("2025-01-01 23:59:59.999999", "a", "q"), ("2025-01-02 00:00:00", "b", "p"),
        ("2025-01-03 12:00:00", "b", "p"), ("2025-01-02 12:00:00", None, None), (None, "c", "r"),
        ("2099-01-01 00:00:00", "c", "r"), ("2024-12-31 23:59:59", "d", "p"),
    ]
    return spark.createDataFrame(
        [(i, i, "t", at(d), p, c) for i, (d, c, p) in enumerate(data)], schemas.NEWS_METADATA
    )


def test_bounds_are_whole_days(metadata):
    def ids(*days):
        return [r[0] for r in rows(analytics.in_range(metadata, *days).select("id"))]

    assert ids("2025-01-01", "2025-01-01") == [0, 1]
    assert ids(dt.date(2025, 1, 2), dt.date(2025, 1, 3)) == [2, 3, 4]
    assert ids(None, "2025-01-01") == [0, 1, 7]
    assert ids("2025-01-01", None, "2025-01-02") == [0, 1, 2, 4]
    assert ids() == [0, 1, 2, 3, 4, 7]  # not the future, not the undated


def test_top(metadata):
    assert [tuple(r) for r in analytics.top_categories(metadata, "2025-01-01", "2025-01-03").collect()] == [
        ("a", 2), ("b", 2), (None, 1)
    ]
    assert [tuple(r) for r in analytics.top_publishers(metadata, limit=1).collect()] == [("p", 4)]
    with pytest.raises(ValueError):
        analytics.top_categories(metadata, limit=0)


def test_counts_differ_for_missing_ids(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 1, 'a'), (2, NULL, 'a'), (3, 3, 'b') AS m(id, news_id, category)"
    ).selectExpr("*", "'p' AS publisher", "timestamp_ntz'2025-01-01' AS published_at")
    assert [tuple(r) for r in analytics.top_categories(df).collect()] == [("a", 1), ("b", 1)]
    assert analytics.total_in_range(df).first().total == 3


def test_report(metadata):
    report = analytics.trend_report(metadata, "2025-01-01", "2025-01-03", 1)
    assert rows(report.categories) == [("a", 2)]
    assert rows(report.publishers) == [("p", 3)]
    assert report.summary.first().sentence == "5 was published from 2025-01-01 to 2025-01-03."
    open_ = analytics.trend_report(metadata, today="2025-01-03").summary.first()
    assert tuple(open_) == (6, "6 was published from 所有時間 to 所有時間.")


def test_table_equals_the_parts(metadata):
    table = analytics.trend_table(metadata, "2025-01-01", "2025-01-03")
    assert rows(table) == sorted(
        [("category", "a", 2, 1), ("category", "b", 2, 2), ("category", None, 1, 3),
         ("publisher", "p", 3, 1), ("publisher", "q", 1, 2), ("publisher", None, 1, 3), ("total", None, 5, 1)],
        key=repr,
    )
