"""Answers kept by content, and failed articles that are tried again when they are due."""

import datetime as dt
import sys
from collections import Counter

import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_stream_state import _rows_scanned

from newsloom import schemas
from newsloom.operators import answer, classify, embed
from newsloom.operators.responses import ResponseLog, content_key, logged
from newsloom.operators.retries import Retries, failures
from newsloom.plans.steps import classify_step
from newsloom.providers import HashedTokenEmbedder, KeywordClassifier
from newsloom.sinks import append, ensure_table
from newsloom.sources import read_table


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this file


class Noted:
    """A provider that writes down what it is asked, and fails as it is told by a file."""

    def __init__(self, provider, folder):
        self.provider, self.folder = provider, str(folder)

    def __call__(self):
        import os
        import uuid

        model = self.provider()

        def call(first, *rest):
            for text in first if isinstance(first, list) else [first]:
                with open(f"{self.folder}/asked-{uuid.uuid4().hex}", "w") as out:
                    out.write(text)
                if os.path.exists(f"{self.folder}/fail") and open(f"{self.folder}/fail").read() in text:
                    raise RuntimeError("away")
            return model(first, *rest)

        return call


def _asked(folder):
    return Counter(p.read_text() for p in folder.glob("asked-*"))


def _texts(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("text "), F.col("id") % 20).alias("chunk_text")).unionByName(
        spark.createDataFrame([(1000, None), (1001, " ")], "id bigint, chunk_text string")
    )


def test_equal_texts_are_embedded_once(spark, tmp_path):
    log = ResponseLog(str(tmp_path / "log"), "hashed 8", round_rows=6)
    provider = Noted(HashedTokenEmbedder(8), tmp_path)
    plain = rows(embed.embed_chunks(_texts(spark, 50), HashedTokenEmbedder(8)))
    for _ in range(2):
        assert rows(embed.embed_chunks(_texts(spark, 50), provider, log=log)) == plain
    assert _asked(tmp_path) == Counter({f"text {i}": 1 for i in range(20)})
    embed.embed_chunks(_texts(spark, 50), provider, log=log._replace(model="hashed 9")).collect()
    assert set(_asked(tmp_path).values()) == {2}  # another model is asked anew


def test_a_round_reads_its_own_questions(spark, tmp_path):
    read = []

    def ask(part):
        read.append(_rows_scanned(part))
        return part.withColumn("answer", F.upper("q"))

    log = ResponseLog(str(tmp_path / "log"), "m", round_rows=20)
    questions = spark.range(300).select(F.concat(F.lit("q"), F.col("id") % 100).alias("q")).repartition(7)
    for _ in range(2):
        got = logged(questions, log, ("q",), ask, ("answer",), F.lit(True))
        assert rows(got) == sorted((f"q{i}", f"Q{i}") for i in range(100) for _ in range(3))
    assert len(read) == 5 and sum(read) == 100
    sizes = [p.stat().st_size for p in (tmp_path / "log").glob("part-*.parquet")]
    assert len(sizes) == 5 and max(sizes) < 100_000  # a file for a round, with a filter for its keys


def test_tasks_of_a_worker_share_the_buckets_of_tokens(monkeypatch):
    from newsloom import providers

    want = HashedTokenEmbedder(8)()(["shared token once", "", "other"]).tolist()
    monkeypatch.setattr(providers.hashlib, "md5", None)  # nothing is left to be hashed
    assert HashedTokenEmbedder(8)()(["shared token once", "", "other"]).tolist() == want


def test_a_killed_run_is_taken_up_where_it_was(spark, tmp_path):
    log = ResponseLog(str(tmp_path / "log"), "hashed 8", round_rows=4)
    provider = Noted(HashedTokenEmbedder(8), tmp_path)
    (tmp_path / "fail").write_text("text 13")
    with pytest.raises(Exception, match="away"):
        embed.embed_chunks(_texts(spark, 50), provider, log=log, fail_fast=True).collect()
    done = {r.chunk_text for r in _texts(spark, 50).collect()} & set(_asked(tmp_path))
    kept = read_table(spark, log.folder).count() if (tmp_path / "log").exists() else 0
    (tmp_path / "fail").unlink()
    before = _asked(tmp_path)
    got = embed.embed_chunks(_texts(spark, 50), provider, log=log, fail_fast=True)
    assert rows(got) == rows(embed.embed_chunks(_texts(spark, 50), HashedTokenEmbedder(8)))
    assert sum((_asked(tmp_path) - before).values()) == 20 - kept
    assert done and read_table(spark, log.folder).where("answered").count() == 20


def test_failed_answers_are_asked_again(spark, tmp_path):
    log = ResponseLog(str(tmp_path / "log"), "m")
    provider = Noted(lambda: lambda prompt, context: f"answer to {prompt}", tmp_path)
    prompts = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "x"), (4, None, None)], "id int, prompt string, context string")
    (tmp_path / "fail").write_text("b")

    def replies():
        return [(r.id, r.response, r.status) for r in sorted(answer.generate_answers(prompts, provider, log=log).collect())]

    assert replies() == [(1, "answer to a", "ok"), (2, None, "error"), (3, None, "error"), (4, None, None)]
    (tmp_path / "fail").unlink()
    assert replies() == [(1, "answer to a", "ok"), (2, "answer to b", "ok"), (3, "answer to b", "ok"), (4, None, None)]
    assert _asked(tmp_path) == Counter(a=1, b=2)
    assert replies()[1] == (2, "answer to b", "ok") and _asked(tmp_path) == Counter(a=1, b=2)


def test_classification_with_a_log(spark, tmp_path):
    articles = spark.range(90).select(
        F.col("id").alias("news_id"), F.lit("t").alias("title"), F.concat(F.lit("money "), "id").alias("summary")
    )
    model = KeywordClassifier([("money", "經濟")], "生活")
    plain = rows(classify.classify_articles(articles, model).select("id", "category"))
    log = ResponseLog(str(tmp_path / "log"), "keywords", round_rows=2)
    for _ in range(2):
        got = classify.classify_articles(articles, Noted(model, tmp_path), log=log)
        assert rows(got.select("id", "category")) == plain
    assert set(_asked(tmp_path).values()) == {1}


def test_no_questions(spark, tmp_path):
    log = ResponseLog(str(tmp_path / "log"), "m")
    prompts = spark.createDataFrame([(1, None, None)], "id int, prompt string, context string")
    got = answer.generate_answers(prompts, lambda: None, log=log)
    assert rows(got) == [(1, None, None, None, None)]


def test_keys_tell_parts_apart(spark):
    pairs = [("ab", "c"), ("a", "bc"), ("ab", None), ("ab", ""), (None, "ab"), ("3:a", "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.select(content_key("m", F.col("a"), F.col("b"))).distinct().count() == len(pairs)


def test_a_question_of_very_many_rows(spark, tmp_path):
    log = ResponseLog(str(tmp_path / "log"), "m")
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("q"))
    got = logged(df, log, ("q",), lambda part: part.withColumn("a", F.upper("q")), ("a",), F.lit(True))
    assert got.where("a = upper(q)").count() == 3000
    assert read_table(spark, log.folder).count() == 2001


def _articles(spark, name):
    tables = [f"{name}_{t}" for t in ("raw", "metadata")]
    for table, schema in zip(tables, (schemas.NEWS_RAW_DATA, schemas.NEWS_METADATA)):
        ensure_table(spark, table, schema)
    data = [(i, f"t{i}", f"l{i}", None, "money", "p", "c") for i in range(6)]
    append(spark.createDataFrame(data, schemas.NEWS_RAW_DATA), tables[0])
    return tables


def test_failures_are_tried_again_when_due(spark, tmp_path):
    raw, metadata = _articles(spark, "retried")
    retries = Retries(str(tmp_path / "journal"), limit=3, wait=dt.timedelta(minutes=20))
    model = Noted(KeywordClassifier([("money", "經濟")], "生活"), tmp_path)
    start = dt.datetime(2025, 1, 1, 12)

    def step(minutes):
        now = start + dt.timedelta(minutes=minutes)
        calls = sum(_asked(tmp_path).values())
        stored = classify_step(spark, raw, metadata, model, size=1, attempts=1, pause=0, retries=retries, now=now)
        return stored, sum(_asked(tmp_path).values()) - calls

    (tmp_path / "fail").write_text('"id":4')
    assert step(0) == (5, 6)
    assert step(10) == (0, 0)  # not due
    assert step(20) == (0, 1)
    assert step(55) == (0, 0)  # due 40 minutes after the second failure
    assert [tuple(r) for r in failures(spark, retries).collect()] == [(4, 2, start + dt.timedelta(minutes=60))]
    (tmp_path / "fail").unlink()
    assert step(60) == (1, 1)
    assert {r.category for r in spark.table(metadata).collect()} == {"經濟"} and step(200) == (0, 0)


def test_the_last_failure_is_stored(spark, tmp_path):
    raw, metadata = _articles(spark, "given_up")
    retries = Retries(str(tmp_path / "journal"), limit=2, wait=dt.timedelta(minutes=1))
    model = Noted(KeywordClassifier([], "生活"), tmp_path)
    (tmp_path / "fail").write_text('"id":4')
    stored = [
        classify_step(spark, raw, metadata, model, size=1, attempts=1, pause=0, retries=retries, now=dt.datetime(2025, 1, 1 + d))
        for d in range(4)
    ]
    assert stored == [5, 1, 0, 0]
    found = {r.news_id: r.category for r in spark.table(metadata).collect()}
    assert found[4] == "API_Error" and sum(f'"id": 4' in t or '"id":4' in t for t in _asked(tmp_path).elements()) == 2


def test_without_retries_labels_are_stored_at_once(spark, tmp_path):
    raw, metadata = _articles(spark, "at_once")
    model = Noted(KeywordClassifier([], "生活"), tmp_path)
    (tmp_path / "fail").write_text('"id":4')
    assert classify_step(spark, raw, metadata, model, size=1, attempts=1, pause=0) == 6
    assert Counter(r.category for r in spark.table(metadata).collect()) == Counter({"生活": 5, "API_Error": 1})
