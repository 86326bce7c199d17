import pytest
from conftest import rows

from newsloom import schemas
from newsloom.plans.steps import classify_step, embed_step
from newsloom.providers import HashedTokenEmbedder, KeywordClassifier
from newsloom.session import shared_folder
from newsloom.sinks import append, ensure_table


@pytest.fixture
def tables(spark, request):
    names = [f"{request.node.name}_{t}" for t in ("raw", "metadata", "chunks")]
    ddl = (schemas.NEWS_RAW_DATA, schemas.NEWS_METADATA, schemas.NEWS_CHUNK_EMBEDDINGS)
    for name, schema in zip(names, ddl):
        ensure_table(spark, name, schema)
    data = [
        (i, f"t{i}", f"l{i}", None, "money" if i % 2 else "goal", "p", None if i == 3 else f"甲{i}。乙{i}。")
        for i in range(40)
    ]
    append(spark.createDataFrame(data, schemas.NEWS_RAW_DATA), names[0])
    return names


CLASSIFIER = KeywordClassifier([("money", "經濟"), ("goal", "體育")], "生活")


def test_backlog_is_worked_off(spark, tables):
    raw, metadata, chunks = tables
    counts = [classify_step(spark, raw, metadata, CLASSIFIER) for _ in range(3)]
    assert counts == [30, 10, 0]
    got = spark.table(metadata).collect()
    assert sorted(r.news_id for r in got) == list(range(40)) and len({r.id for r in got}) == 40
    assert {(r.news_id % 2, r.category) for r in got} == {(0, "體育"), (1, "經濟")}

    embedder = HashedTokenEmbedder(8)
    counts = [embed_step(spark, raw, metadata, chunks, embedder, limit=25, parallelism=4) for _ in range(3)]
    assert counts == [25, 15, 0]
    got = spark.table(chunks).collect()
    assert len({r.id for r in got}) == 40
    marker = next(r for r in got if r.news_id == 3)
    assert (marker.chunk_text, marker.embedding) == (None, None) and "no_content" in marker.metadata
    assert next(r for r in got if r.news_id == 4).chunk_text == "甲4。乙4。"
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in got if r.embedding)


def test_failed_batches(spark, tables):
    def broken():
        return lambda prompt, payload: "no json"

    raw, metadata, chunks = tables
    assert classify_step(spark, raw, metadata, broken, skip_failed=True) == 0
    assert classify_step(spark, raw, metadata, broken) == 30
    assert {r.category for r in spark.table(metadata).collect()} == {"JSON_Parse_Error"}
    # Articles without metadata wait, unless told otherwise.
    embedder = HashedTokenEmbedder(8)
    assert embed_step(spark, raw, metadata, chunks, embedder) == 30
    assert embed_step(spark, raw, metadata, chunks, embedder, require_metadata=False) == 10
    assert [r[0] for r in rows(spark.table(chunks).select("news_id"))] == sorted(range(40), key=lambda i: repr((i,)))


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
