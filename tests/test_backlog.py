import datetime as dt

import pytest
from conftest import rows

from newsloom import schemas
from newsloom.operators.backlog import unclassified_backlog, unembedded_backlog


def day(n):
    return dt.datetime(2025, 1, n)


@pytest.fixture(scope="module")
def raw(spark):
    data = [
        (1, "t1", "l", day(1), "s1", "p", "c1"), (2, "t2", "l", day(3), "s2", "p", "c2"),
        (3, "t3", "l", None, "s3", "p", None), (4, "t4", "l", day(3), "s4", "p", "c4"),
        (5, "t5", "l", day(2), "s5", "p", "c5"),
    ]
    return spark.createDataFrame(data, schemas.NEWS_RAW_DATA)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "news_id bigint")


def metadata(spark, *values):
    return spark.createDataFrame(
        [(i, v, f"m{v}", day(4), "mp", "社會") for i, v in enumerate(values)], schemas.NEWS_METADATA
    )


def picked(df):
    return [r.news_id for r in df.collect()]


def test_newest_first_undated_before_all(spark, raw):
    got = unclassified_backlog(raw, ids(spark, 5, 5, 5), limit=3)
    assert picked(got) == [3, 2, 4]
    assert tuple(got.collect()[1]) == (2, "t2", "2025-01-03 00:00:00", "p", "s2")
    assert got.columns == ["news_id", "title", "published_at", "publisher", "summary"]


def test_without_limit(spark, raw):
    assert sorted(picked(unclassified_backlog(raw, ids(spark, 5), limit=None))) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        unclassified_backlog(raw, ids(spark), limit=0)


def test_null_ids_hide_nothing_unless_asked(spark, raw):
    assert len(picked(unclassified_backlog(raw, ids(spark, 5, None)))) == 4
    assert picked(unclassified_backlog(raw, ids(spark, 5, None), null_aware=True)) == []
    assert len(picked(unclassified_backlog(raw, ids(spark, 5), null_aware=True))) == 4
    assert len(picked(unclassified_backlog(raw, ids(spark), null_aware=True))) == 5


@pytest.mark.parametrize("limit", [50, None])
def test_unembedded(spark, raw, limit):
    known, chunks = metadata(spark, 1, 2, 3), ids(spark, 2, 2, None)
    got = unembedded_backlog(raw, known, chunks, limit=limit)
    assert rows(got) == [
        (1, "c1", "m1", "2025-01-04 00:00:00", "mp", "社會"),
        (3, None, "m3", "2025-01-04 00:00:00", "mp", "社會"),
    ]
    everything = unembedded_backlog(raw, known, chunks, limit=limit, require_metadata=False)
    assert rows(everything)[2:] == [(4, "c4", None, None, None, None), (5, "c5", None, None, None, None)]


def test_unembedded_limit_is_lowest_ids(spark, raw):
    known = metadata(spark, 5, 4, 2, 1)
    assert picked(unembedded_backlog(raw, known, ids(spark, 1), limit=2)) == [2, 4]
    assert picked(unembedded_backlog(raw, known, ids(spark, 1), limit=3, require_metadata=False)) == [2, 3, 4]
