"""Writes that lose nothing, calls that are spread, and copies that are removed."""

import os

import pytest
from conftest import DATA
from pyspark import TaskContext
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.models import spread
from newsloom.operators import answer, backlog, classify, search
from newsloom.plans.sample import Sample
from newsloom.plans.steps import classify_step, embed_step
from newsloom.providers import HashedTokenEmbedder, KeywordClassifier
from newsloom.sinks import append, append_new, ensure_table, insert_if_absent, update_table


@pytest.fixture(params=["table", "path"])
def target(spark, request, tmp_path):
    """A table and a path, both partitioned by two columns, one with odd values."""
    if request.param == "path":
        path = str(tmp_path / "target")
        spark.createDataFrame([(1, "a", "x=1/é '", 7)], "id bigint, v string, p string, q int").write.partitionBy(
            "p", "q"
        ).parquet(path)
        yield path
    else:
        spark.sql("DROP TABLE IF EXISTS parted")
        ensure_table(spark, "parted", "id bigint, v string, p string, q int", ["p", "q"])
        append(spark.createDataFrame([(1, "a", "x=1/é '", 7)], "id bigint, v string, p string, q int"), "parted")
        yield "parted"
        spark.sql("DROP TABLE IF EXISTS parted")


def stored(spark, target):
    if "/" in target:
        frame = spark.read.parquet(target)
    else:
        frame = spark.table(target)
    return sorted((r.id, r.v, r.p, r.q) for r in frame.collect())


def test_appends_to_partitions_are_read_back(spark, target):
    more = spark.createDataFrame([("b", "y", 8), ("c", "x=1/é '", 7)], "v string, p string, q int")
    assert append(more, target, id_col="id") == 2
    assert [r[0] for r in stored(spark, target)] == [1, 2, 3]
    assert append_new(more, target, "v", id_col="id") == 0
    new = spark.createDataFrame([("d", None, 9)], "v string, p string, q int")
    assert append_new(new, target, "v", id_col="id") == 1
    assert insert_if_absent(new.withColumn("id", F.lit(9).cast("bigint")), target, "id", ["v"]) == 1
    assert stored(spark, target)[-1] == (9, "d", None, 9)


def test_updates_of_partitions_are_visible(spark, target, tmp_path):
    append(spark.createDataFrame([(2, "b", "y", 8), (3, "c", "y", 9)], "id bigint, v string, p string, q int"), target)
    updates = spark.createDataFrame([(1, "A", "x=1/é '", 1), (3, "C", "z", 1)], "id bigint, v string, p string, o int")
    where = str(tmp_path / "snapshot")
    assert update_table(spark, target, updates, "id", ["v", "p"], ["o"], where) == 2
    got = stored(spark, where if "/" in target else target)
    assert got == [(1, "A", "x=1/é '", 7), (2, "b", "y", 8), (3, "C", "z", 9)]
    if "/" not in target:
        append(spark.createDataFrame([(4, "e", "y", 8)], "id bigint, v string, p string, q int"), target)
        assert len(stored(spark, target)) == 4


def test_ids_follow_without_gaps(spark, tmp_path):
    path = str(tmp_path / "ids")
    append(spark.range(1000).repartition(7).select(F.col("id").alias("v")), path, id_col="id")
    append(spark.range(500).repartition(5).select(F.col("id").alias("v")), path, id_col="id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(1, 1501))


def test_calls_are_spread(spark):
    articles = spark.range(20_000).select(
        F.col("id").alias("news_id"), F.lit("t").alias("title"), F.lit("s").alias("summary")
    )
    def where():  # answers with the task it runs in
        return lambda prompt, payload: '[{"id": %d, "category": "c"}]' % TaskContext.get().partitionId()

    assert classify.classify_articles(articles, where).select("id").distinct().count() == 8
    behind = articles.orderBy("news_id").limit(5000)
    assert classify.classify_articles(behind, where).select("id").distinct().count() == 8
    assert spread(behind).select(F.spark_partition_id()).distinct().count() == 8


def test_answers_with_ids_as_text_and_odd_fields(spark):
    cases = {
        '{"summary": "s", "references": [{"news_id": "12", "title": "t"}, {"news_id": "x"}]}': ("ok", [12, None]),
        '{"summary": "s", "references": [{"news_id": 3}]}': ("ok", [3]),
        '{"summary": 5, "references": "none"}': ("ok", []),
        '{"summary": "s"}': ("ok", []),
        '{"summary": "s", ': ("bad_json", []),
        "[1]": ("bad_json", []),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "r string")
    got = rows.select("r", answer.parse_answer(F.col("r"), F.lit("ok")).alias("a")).collect()
    assert {r.r: (r.a.status, [x.news_id for x in r.a.references]) for r in got} == cases


@pytest.mark.parametrize("reply, label", [("null", "API_Error"), ("5", "API_Error"), ('{"results": []}', "API_Error"),
                                          ('{"id": 1, "category": "c"}', "c"), ("[{", "JSON_Parse_Error")])
def test_labels_of_odd_replies(spark, reply, label):
    articles = spark.createDataFrame([(1, "t", "s")], "news_id bigint, title string, summary string")
    provider = lambda: lambda prompt, payload: reply
    rows = classify.classify_articles(articles, provider, attempts=2, pause=0).collect()
    assert [(r.id, r.category) for r in rows] == [(1, label)]


@pytest.mark.parametrize("most", [1 << 30, 1])
def test_vectors_without_direction_are_hits_and_come_last(spark, most):
    nan = float("nan")
    chunks = spark.createDataFrame(
        [(1, 1, [1.0, 0.0]), (2, 2, [nan, 1.0]), (3, 3, [None, 1.0]), (4, 4, [0.0, 0.0]), (None, 5, [1.0, 0.0]),
         (6, 6, None), (7, 7, [float("inf"), 1.0])],
        "id bigint, news_id bigint, embedding array<float>",
    )
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    for k in (5, 9):
        got = search.nearest_batch(chunks, queries, k, most).orderBy("rank").collect()
        assert [(r.id, r.similarity) for r in got] == [(1, 1.0), (2, None), (3, None), (4, None), (7, None)]


def test_few_ids_reach_the_reader(spark):
    s = Sample(spark, f"{DATA}/sf0.001")
    raw, chunks = s.table("documents").withColumnRenamed("doc_id", "id"), s.table("embeddings").withColumnRenamed("vec_id", "id")
    raw = raw.selectExpr("id", "text AS link", "text AS title", "text AS summary", "source AS publisher", "NULL AS published_at")
    plan = search.search_top_k(chunks.selectExpr("id", "id AS news_id", "embedding", "label AS chunk_text"), raw, [1.0] * 64)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("In(vec_id") == 1 and text.count("In(doc_id") == 1
    rows = backlog.unclassified_backlog(raw, s.labelled(), 5)
    assert "In(doc_id" in rows._jdf.queryExecution().executedPlan().toString()


def test_steps_leave_no_copies(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    raw, metadata, chunks = (str(tmp_path / n) for n in ("raw", "metadata", "chunks"))
    spark.createDataFrame([(i, f"t{i}", f"l{i}", None, "s", "p", "A. B.") for i in range(4)], schemas.NEWS_RAW_DATA).write.parquet(raw)
    spark.createDataFrame([], schemas.NEWS_METADATA).write.parquet(metadata)
    spark.createDataFrame([], schemas.NEWS_CHUNK_EMBEDDINGS).write.parquet(chunks)
    assert classify_step(spark, raw, metadata, KeywordClassifier((), "c")) == 4
    assert embed_step(spark, raw, metadata, chunks, HashedTokenEmbedder(8)) == 4
    assert sorted(r.id for r in spark.read.parquet(metadata).collect()) == [1, 2, 3, 4]
    assert set(os.listdir(folder)) == before


def test_a_broken_model_may_end_the_job(spark):
    from newsloom.operators.embed import embed_chunks

    def broken():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("bad text")
            return [[1.0, 0.0]] * len(texts)

        return embed

    chunks = spark.createDataFrame([(1, "good"), (2, "bad")], "id bigint, chunk_text string")
    got = {r.id: r.embedding for r in embed_chunks(chunks, broken).collect()}
    assert got == {1: [1.0, 0.0], 2: None}
    assert {r.embedding for r in embed_chunks(chunks, broken, dim=3).select("embedding").collect()} == {None}
    with pytest.raises(Exception, match="bad text"):
        embed_chunks(chunks, broken, fail_fast=True).collect()
