import json

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import answer
from newsloom.operators.embed import embed_chunks, embed_queries
from newsloom.plans.steps import answer_queries
from newsloom.providers import FirstHitAnswerer, HashedTokenEmbedder


def scripted(responses):
    def provider():
        def reply(prompt, context):
            value = responses[context]
            if value is TimeoutError:
                raise TimeoutError
            return value

        return reply

    return provider


GOOD = json.dumps({"summary": "總結", "references": [{"news_id": 1, "title": "t", "publisher": "p"}]})
CASES = {
    "good": (GOOD, "ok", "總結", 1),
    "no references": ('{"summary": "s"}', "ok", "s", 0),
    "empty": ("", "empty", "很抱歉，我無法處理您的請求，請稍後再試。", 0),
    "none": (None, "empty", "很抱歉，我無法處理您的請求，請稍後再試。", 0),
    "broken": ('{"summary": "s"', "bad_json", "很抱歉，模型返回了無法解析的資料。請稍後再試。", 0),
    "text": ("sorry", "bad_json", "很抱歉，模型返回了無法解析的資料。請稍後再試。", 0),
    "error": (TimeoutError, "error", "很抱歉，與模型通訊時發生錯誤。請稍後再試。", 0),
}


@pytest.mark.parametrize("parallelism", [None, 3])
def test_answers_and_failures(spark, parallelism):
    names = list(CASES)
    prompts = spark.createDataFrame(
        [(i, "p", n) for i, n in enumerate(names)], "query_id bigint, prompt string, context string"
    )
    provider = scripted({n: c[0] for n, c in CASES.items()})
    got = answer.generate_answers(prompts, provider, parallelism).select(
        "query_id", answer.parse_answer(F.col("response"), F.col("status")).alias("a")
    )
    found = {names[r.query_id]: (r.a.status, r.a.summary, len(r.a.references)) for r in got.collect()}
    assert found == {n: c[1:] for n, c in CASES.items()}


def resolved(spark, references, results):
    df = spark.createDataFrame(
        [("s", references, results)], f"summary string, refs array<{schemas.REFERENCE}>, results {schemas.CONTEXT}"
    )
    links = answer.resolve_references(F.col("refs"), F.col("results"))
    return df.select(links.alias("r"), answer.render_answer(F.col("summary"), links).alias("t")).first()


def hit(news_id, link):
    return (news_id, 0.5, "c", "", None, link)


def test_references(spark):
    got = resolved(
        spark,
        [(1, "t1", "p1"), (2, None, None), (3, "t3", "p3"), (None, "t", "p")],
        [hit(1, "old"), hit(1, "l1"), hit(1, ""), hit(1, None), hit(3, None)],
    )
    assert [tuple(r) for r in got.r] == [
        (1, "t1", "p1", "l1"), (2, "未知標題", "未知來源", "#"), (3, "t3", "p3", "#"), (None, "t", "p", "#"),
    ]
    assert got.t.startswith("s\n\n**參考資料：**\n- [t1](l1) - p1\n- [未知標題](#) - 未知來源\n")


def test_no_references_no_heading(spark):
    assert resolved(spark, [], [hit(1, "l")]).t == "s"


def test_context_json_is_json(spark):
    df = spark.createDataFrame(
        [([(1, 0.123456789, 'say "hi"\n', "full", '{"title":"標題"}', None), (None, None, None, "", None, "l")],)],
        f"results {schemas.CONTEXT}",
    )
    assert json.loads(df.select(answer.context_json(F.col("results"))).first()[0]) == [
        {"news_id": 1, "similarity": 0.123457, "chunk_text": 'say "hi"\n', "full_article": "full",
         "link": None, "meta_data": {"title": "標題"}},
        {"news_id": None, "similarity": None, "chunk_text": None, "full_article": "", "link": "l", "meta_data": None},
    ]


def test_prompt_slots(spark):
    df = spark.createDataFrame([("q {results}", "[{}]")], "q string, c string")
    got = df.select(answer.render_answer_prompt(F.col("q"), F.col("c"), "<{query}|{results}>")).first()[0]
    assert got == "<q {results}|[{}]>"
    with pytest.raises(ValueError):
        answer.render_answer_prompt(F.col("q"), F.col("c"), "{results} {query}")


def test_embedding_of_blank_and_failing_texts(spark):
    def provider():
        def embed(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return [[3.0, 4.0] for _ in texts]

        return embed

    df = spark.createDataFrame(
        [(1, "good"), (2, "bad"), (3, None), (4, " 　"), (5, "fine")], "id bigint, chunk_text string"
    )
    for parallelism in (None, 2):
        got = {r.id: r.embedding for r in embed_chunks(df, provider, parallelism=parallelism).collect()}
        unit = pytest.approx([0.6, 0.8])
        assert got == {1: unit, 2: None, 3: None, 4: None, 5: unit}
    asked = df.withColumnRenamed("chunk_text", "query").where("id = 1")
    assert embed_queries(asked, provider).first().embedding == [3.0, 4.0]


def test_whole_answers(spark):
    embedder = HashedTokenEmbedder(16)
    raw = spark.createDataFrame(
        [(1, "l1", "all about cats"), (2, "l2", "all about dogs")], "id bigint, link string, content string"
    )
    chunks = embed_chunks(
        spark.createDataFrame(
            [(1, 1, "cats purr", '{"title":"Cats","publisher":"A"}'), (2, 2, "dogs bark", None)],
            "id bigint, news_id bigint, chunk_text string, metadata string",
        ),
        embedder,
    )
    queries = spark.createDataFrame([(1, "cats purr"), (2, "dogs")], "query_id bigint, query string")
    got = {r.query_id: r for r in answer_queries(queries, chunks, raw, embedder, FirstHitAnswerer(), k=2).collect()}
    assert got[1].answer.summary == "cats purr" and got[2].answer.summary == "dogs bark"
    assert [r.full_article for r in got[1].results] == ["all about cats", "all about dogs"]
    assert got[1].text == "cats purr\n\n**參考資料：**\n- [Cats](l1) - A\n- [未知標題](l2) - 未知來源\n"
    nothing = answer_queries(queries, chunks.limit(0), raw, embedder, scripted({})).collect()
    assert {(r.answer.status, r.text, len(r.results)) for r in nothing} == {
        ("no_hits", "根據目前的新聞內容，無法準確回答此問題。", 0)
    }
