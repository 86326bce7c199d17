from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions.text import WHITE_SPACE, classifier_text, split_sentences, strip
from newsloom.operators.chunk import chunk_articles, chunk_metadata
from conftest import rows


def plain_chunks(text, limit=300, overlap=50):
    """What the rule says, one sentence after the other."""
    pieces, piece = [], ""
    for mark in "！？":
        text = text.replace(mark, "。")
    for sentence in filter(None, (part.strip() for part in text.split("。"))):
        if len(piece) + len(sentence) <= limit:
            piece = f"{piece}{sentence}。"
            continue
        pieces.append(piece)
        keep = max(len(piece) - overlap, 0)
        piece = piece[keep:] + sentence
    return [p for p in [*pieces, piece] if p]


def chunked(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "news_id bigint, content string")
    found = {i: [] for i in range(len(texts))}
    for row in chunk_articles(df, **options).orderBy("news_id", "chunk_idx").collect():
        assert row.chunk_idx == len(found[row.news_id])
        found[row.news_id].append(row.chunk_text)
    return [found[i] for i in range(len(texts))]


LITERAL = [
    "。", "短句。", "甲" * 700, "甲" * 300, "甲" * 301, "甲" * 150 + "。" + "乙" * 149,
    "甲" * 150 + "。" + "乙" * 150, "　前。　後　！", "😀" * 200 + "？" + "😀" * 120,
    "no marks at all", "\x1c\x1d甲\x1e\x1f。", "甲。" * 400, "甲" * 299 + "。" + "乙" * 60 + "。" + "丙" * 400,
]


def test_literal_texts(spark):
    got = chunked(spark, LITERAL)
    assert got == [plain_chunks(t) or [None] for t in LITERAL]


def test_no_overlap(spark):
    assert chunked(spark, LITERAL, overlap=0) == [plain_chunks(t, overlap=0) or [None] for t in LITERAL]


def test_marker_for_missing_empty_and_blank(spark):
    df = spark.createDataFrame(
        [(1, None), (2, ""), (3, " 　\n"), (4, "。！？")], "news_id bigint, content string"
    )
    assert rows(chunk_articles(df)) == [(i, 0, None, "no_content") for i in (1, 2, 3, 4)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(
            st.one_of(
                st.text(alphabet="甲ab 　。！？😀\n", max_size=120),
                st.integers(1, 400).map(lambda n: "字" * n),
            ),
            max_size=12,
        ).map("。".join),
        min_size=1,
        max_size=12,
    )
)
def test_random_texts(spark, texts):
    assert chunked(spark, texts) == [plain_chunks(t) or [None] for t in texts]


def test_strip_is_python_strip(spark):
    assert all(c.isspace() for c in WHITE_SPACE)
    assert set(WHITE_SPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    df = spark.createDataFrame([(f"{WHITE_SPACE}a b{WHITE_SPACE}",)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == "a b"


def test_split_sentences(spark):
    df = spark.createDataFrame([("一。二！ 　？三",), (None,)], "t string")
    assert [r[0] for r in df.select(split_sentences(F.col("t"))).collect()] == [["一", "二", "三"], None]


def test_metadata_json(spark):
    df = spark.createDataFrame(
        [(1, "標\"題", None, "p", "社會", "甲。乙"), (2, None, "2024-01-01 00:00:00", None, None, None)],
        "news_id bigint, title string, published_at string, publisher string, category string, content string",
    )
    assert rows(chunk_metadata(chunk_articles(df))) == [
        (1, "甲。乙。",
         '{"news_id":1,"title":"標\\"題","published_at":null,"publisher":"p","category":"社會","chunk_idx":0}'),
        (2, None,
         '{"news_id":2,"title":null,"published_at":"2024-01-01 00:00:00","publisher":null,"category":null,'
         '"chunk_idx":0,"status":"no_content"}'),
    ]


def test_classifier_text(spark):
    df = spark.createDataFrame(
        [("t", "s"), ("t", None), ("", "s"), (None, ""), (None, None)], "title string, summary string"
    )
    got = [r[0] for r in df.select(classifier_text(F.col("title"), F.col("summary"))).collect()]
    assert got == ["標題：t; 摘要：s", "標題：t", "摘要：s", "無資料", "無資料"]


def test_short_chunks_and_many_blocks(spark):
    """Tails that reach over several chunks, and articles of many fold blocks."""
    import random

    rng = random.Random(4)
    texts = ["。".join("字" * rng.choice((1, 2, 3, 9, 40, 80)) for _ in range(n)) for n in (1, 63, 64, 65, 128, 1000)]
    for limit, overlap in ((1, 50), (10, 7), (60, 59), (300, 50), (3, 100)):
        got = chunked(spark, texts, max_length=limit, overlap=overlap)
        assert got == [plain_chunks(t, limit, overlap) or [None] for t in texts]


def test_time_grows_with_the_text(spark):
    """Twice the sentences take about twice the time, and 80,000 a few seconds at most."""
    import time

    def seconds(n):
        text = F.concat_ws("。", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.repeat(F.lit("字"), i % 190 + 1)))
        df = spark.range(1).select(F.col("id").alias("news_id"), text.alias("content")).cache()
        best = 1e9
        for _ in range(3):
            begun = time.perf_counter()
            chunk_articles(df).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - begun)
        return best

    seconds(2000)
    half, whole = seconds(40_000), seconds(80_000)
    assert whole < 3.2 * half and whole < 8
