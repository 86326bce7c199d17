"""Metadata along a curve, and its pages."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom.operators import clustered
from newsloom.operators.search import metadata_filter, metadata_search


def _metadata(spark, n=20_000):
    spread = F.xxhash64("id")
    return spark.range(n).select(
        "id",
        F.col("id").alias("news_id"),
        F.concat(F.lit("title "), "id").alias("title"),
        F.when(
            F.col("id") % 97 != 0, F.expr("timestamp_ntz'2025-01-01' + make_dt_interval(0, int(pmod(xxhash64(id), 9000)))")
        ).alias("published_at"),
        F.when(F.col("id") % 89 != 0, F.concat(F.lit("p"), F.pmod(spread, F.lit(211)))).alias("publisher"),
        F.when(F.col("id") % 83 != 0, F.concat(F.lit("c"), F.pmod(F.shiftright(spread, 20), F.lit(9)))).alias("category"),
    )


SEARCHES = [
    {"category": "c3", "publisher": "p17"},
    {"publisher": "p200", "start": "2025-02-01", "end": "2025-03-01"},
    {"category": "c8", "start": "2025-11-01"},
    {"category": "c0", "publisher": "p3", "end": "2025-04-01"},
]


def _rows_scanned(df):
    df.collect()
    stack, total = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_fewer_row_groups_are_read(spark, tmp_path):
    metadata = _metadata(spark).cache()
    folders = {"plain": str(tmp_path / "plain"), "curve": str(tmp_path / "curve")}
    metadata.repartition(8).write.option("parquet.block.size", 4096).option("parquet.page.size.row.check.min", 50).parquet(folders["plain"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        clustered.write_clustered(metadata, folders["curve"], row_group_bytes=4096)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows(spark.read.parquet(folders["curve"])) == rows(metadata)
    for search in SEARCHES:
        read = {}
        for name, folder in folders.items():
            found = metadata_filter(spark.read.parquet(folder), **search)
            read[name] = _rows_scanned(found)
            assert found.count() == metadata_filter(metadata, **search).count()
        assert read["curve"] < 0.6 * read["plain"], (search, read)


def test_pages_together_are_the_whole_result(spark):
    metadata = _metadata(spark, 2000).cache()
    extra = metadata.limit(3).withColumn("id", F.lit(None).cast("bigint"))
    raw = spark.range(1500).select("id", F.concat(F.lit("http://n/"), "id").alias("link"))
    for search in ({}, {"category": "c3"}, {"start": "2025-02-01", "end": "2025-05-01"}, {"publisher": "none"}):
        for size in (7, 400, 5000):
            if not search and size == 7:
                continue
            got, after, pages = [], None, 0
            while pages == 0 or after is not None:
                page = clustered.metadata_page(metadata.unionByName(extra), raw, size, after, **search)
                got += [tuple(r) for r in page.rows.collect()]
                after, pages = page.after, pages + 1
                if pages > 8 and size == 7:
                    break
            want = [tuple(r) for r in metadata_search(metadata, raw, **search)[1].collect()]
            if after is None:
                assert sorted(got, key=repr) == sorted(want, key=repr)
            else:
                assert len(set(got)) == 63 and set(got) <= set(want)


def test_order_and_undated_rows(spark):
    data = [(1, None), (2, dt.datetime(2025, 1, 1)), (3, dt.datetime(2025, 1, 2)), (4, None), (5, dt.datetime(2025, 1, 2))]
    metadata = spark.createDataFrame([(i, i, f"t{i}", at, "p", "c") for i, at in data],
                                     "id bigint, news_id bigint, title string, published_at timestamp_ntz, publisher string, category string")
    raw = spark.createDataFrame([(1, "l1")], "id bigint, link string")
    order, after = [], None
    for _ in range(5):
        page = clustered.metadata_page(metadata, raw, 1, after)
        order += [r.title for r in page.rows.collect()]
        after = page.after
    assert order == ["t1", "t4", "t3", "t5", "t2"]
    assert clustered.metadata_page(metadata, raw, 1, after).rows.collect() == []
    with pytest.raises(ValueError):
        clustered.metadata_page(metadata, raw, 0)


def test_curve_and_ranges(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(clustered.curve([F.col("a"), F.col("b")], 2)).collect()] == [0, 2, 1, 14]
    cuts = clustered._cuts([5, 1, None, 3, 2, 4] * 10, 2)
    values = spark.createDataFrame([(v,) for v in (None, 0, 1, 2, 3, 4, 5, 9)], "v int")
    got = [r[0] for r in values.select(clustered._range_of(F.col("v"), cuts)).collect()]
    assert got == [0] + [sum(c <= v for c in cuts) for v in (0, 1, 2, 3, 4, 5, 9)]
    assert clustered._cuts([None, None], 6) == [] and clustered._cuts(["x"] * 9, 6) == ["x"]


def test_empty_table(spark, tmp_path):
    clustered.write_clustered(_metadata(spark, 10).limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0
