"""The physical plans the operators are written for."""

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.operators import analytics, search
from newsloom.operators.upsert import first_per_key, unseen
from newsloom.plans.catalog import registered
from newsloom.plans.sample import Sample

PYTHON = {"article_body", "extract_pages", "classify_articles", "join_back", "embed_chunks",
          "embed_queries", "parse_answer", "resolve_references", "render_answer",
          "classify_batches", "classify_backlog", "embed_backlog"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def sample(spark):
    return Sample(spark, f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(registered()))
def test_no_pairing_joins_and_python_once(spark, name):
    text = final(registered()[name](spark, f"{DATA}/sf0.001"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("ArrowEvalPython") == (1 if name in PYTHON else 0)
    assert text.count("MapInArrow") <= 1
    assert "BatchEvalPython" not in text


def test_search_limits_before_the_shuffle(sample):
    text = plan(search.nearest_batch(sample.chunks(), sample.queries()))
    assert re.search(r"WindowGroupLimit .*Final[\s\S]*Exchange hash[\s\S]*WindowGroupLimit .*Partial", text)


def test_search_scans_vectors_and_texts_apart(sample):
    df = search.search_top_k(sample.chunks(), sample.raw(), [0.0] * 64)
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", final(df))
    # the vectors were scanned before; what is left reads the hits' rows by their ids
    assert len(schemas) == 2 and not any("embedding" in s for s in schemas)
    many = final(search.search_top_k_batch(sample.chunks(), sample.raw(), sample.queries()))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", many)
    assert sum("embedding" in s for s in schemas) == 1
    assert all(not ("embedding" in s and "label" in s) for s in schemas)


def test_first_per_key_limits_before_the_shuffle(sample):
    turns = sample.table("conversations")
    assert "Partial" in re.search(r"WindowGroupLimit .*\n.*Sort.*\n.*FileScan|WindowGroupLimit .*Partial",
                                  plan(first_per_key(turns, "conv_id", "turn"))).group(0)


def test_large_batches_are_hash_joined_on_distinct_keys(spark, sample):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(unseen(sample.raw(), sample.raw(), "link", max_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin|ShuffledHashJoin", text) and "LeftAnti" in text
    assert text.count("HashAggregate") == 2


def test_top_lists(sample):
    text = plan(analytics.top_categories(sample.metadata(), "2024-01-05", "2024-01-06"))
    assert "TakeOrderedAndProject" in text
    assert "partial_count" in text
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,.*LessThanOrEqual\(ts,", text)
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>", text)


def test_trend_table_scans_once(sample):
    text = plan(analytics.trend_table(sample.metadata(), "2024-01-05", "2024-01-06"))
    assert text.count("FileScan") == 1 and "WindowGroupLimit" in text


def test_chunking_needs_no_shuffle(spark):
    assert "Exchange" not in plan(entry.queries()["chunk_metadata"](spark, f"{DATA}/sf0.001"))


def test_backlog_never_shuffles_text(spark, sample):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(entry.queries()["unclassified_backlog"](spark, f"{DATA}/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "In(doc_id" in text and "Exchange" not in text


def test_hot_link_is_split(spark):
    """A third of the feed shares one link: its partition is read in pieces."""
    from newsloom.sources import attach_pages

    feed = spark.range(300_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("http://n/"), "id")).alias("link"),
        F.sha2(F.col("id").cast("string"), 512).alias("title"),
    )
    pages = spark.range(1000).select(F.concat(F.lit("http://n/"), "id").alias("url"), F.lit("c").alias("content"))
    pages = pages.union(spark.sql("SELECT 'hot', 'h'"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = attach_pages(feed, pages)
        text = final(joined)
        counts = joined.groupBy("content").count().collect()
    finally:
        for key in small:
            spark.conf.unset(key)
    assert "skew=true" in text
    assert {r.content: r["count"] for r in counts} == {"h": 100_000, "c": 666, None: 199_334}
