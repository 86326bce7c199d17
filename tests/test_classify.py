import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom.operators import classify

ARTICLES = "news_id bigint, title string, summary string"


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([(i, f"t{i}", "s" if i % 2 else None) for i in range(40)], ARTICLES)


def test_batches_cover_every_article_once(spark, articles):
    for buckets in (1, 3, None):
        got = classify.make_batches(articles, size=15, buckets=buckets).collect()
        assert sorted(i for r in got for i in r.ids) == list(range(40))
        for r in got:
            items = json.loads(r["items"])
            assert [i["id"] for i in items] == r.ids == sorted(r.ids)
        # Only the last batch of a bucket may be short.
        full = [len(r.ids) for r in got if (r.bucket, r.batch + 1) in {(o.bucket, o.batch) for o in got}]
        assert set(full) <= {15}
    assert sorted(len(r.ids) for r in classify.make_batches(articles).collect()) == [10, 15, 15]


def test_batches_in_another_order(spark, articles):
    got = classify.make_batches(articles, size=20, buckets=1, order=[F.desc("news_id")]).collect()
    assert {r.batch: r.ids for r in got} == {0: list(range(39, 19, -1)), 1: list(range(19, -1, -1))}


def test_no_articles(spark, articles):
    assert classify.make_batches(articles.limit(0)).count() == 0
    with pytest.raises(ValueError):
        classify.make_batches(articles, size=0)


def test_prompt(spark):
    df = spark.createDataFrame([('[{"id":1}]',)], "items string")
    got = df.select(classify.render_classify_prompt(F.col("items"), ["甲", "乙"])).first()[0]
    assert "[甲, 乙]" in got and got.endswith('[{"id":1}]')
    with pytest.raises(ValueError):
        classify.render_classify_prompt(F.col("items"), template="none")


def by_lowest_id():
    """A provider, as a local function so that Spark ships it by value."""

    def provider():
        calls = {}

        def answer(prompt, payload):
            ids = [i["id"] for i in json.loads(payload)]
            first = min(ids)
            calls[first] = calls.get(first, 0) + 1
            if first == 0:
                return json.dumps([{"id": i, "category": f"c{i}"} for i in [*ids, 999, ids[0]]])
            if first == 5:
                return "not json"
            if first == 10:
                raise TimeoutError
            if first == 15:
                return ""
            if first == 20:
                if calls[first] < 3:
                    raise TimeoutError
                return json.dumps([{"id": i, "category": None} for i in ids[1:]])
            if first == 25:
                return "[]" if calls[first] > 1 else None
            return json.dumps({"id": first, "category": f"only after {calls[first]}"})

        return answer

    return provider


def test_failures(spark, articles):
    batches = classify.make_batches(articles.where("news_id < 35"), size=5, buckets=1)
    prompts = batches.withColumn("prompt", classify.render_classify_prompt(F.col("items")))
    responses = classify.classify_batches(prompts, by_lowest_id(), pause=0, parallelism=3)
    status = {r.ids[0]: r.status for r in responses.collect()}
    assert status == {
        0: "ok", 5: "JSON_Parse_Error", 10: "API_Error", 15: "API_Error", 20: "ok", 25: "ok", 30: "ok",
    }
    got = classify.explode_classified(responses)
    by_batch = {}
    for r in got.orderBy("batch", "place").collect():
        by_batch.setdefault(r.batch * 5, []).append((r.id, r.category))
    assert by_batch[0] == [(0, "c0"), (1, "c1"), (2, "c2"), (3, "c3"), (4, "c4"), (999, "c999"), (0, "c0")]
    assert by_batch[5] == [(i, "JSON_Parse_Error") for i in range(5, 10)]
    assert by_batch[10] == [(i, "API_Error") for i in range(10, 15)]
    assert by_batch[15] == [(i, "API_Error") for i in range(15, 20)]
    assert by_batch[20] == [(i, None) for i in range(21, 25)]
    assert by_batch[30] == [(30, "only after 1")]
    joined = classify.join_back(got.select("id", "category"), articles.select("news_id", "title"))
    found = rows(joined)
    assert (0, "t0", "c0") in found and found.count((0, "t0", "c0")) == 2
    assert all(r[0] != 999 and r[0] != 20 for r in found)
