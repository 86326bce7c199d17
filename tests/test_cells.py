"""Pruned search gives what a full scan gives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import cells
from newsloom.operators.search import nearest_batch, search_top_k_batch
from newsloom.session import scratch

CHUNKS = "id bigint, news_id bigint, embedding array<float>, chunk_text string"


def _clustered(rng, n, dim=16, groups=12, spread=0.08):
    centers = rng.normal(size=(groups, dim))
    points = centers[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return (points / np.sqrt((points**2).sum(axis=1))[:, None]).astype(np.float32)


def _rows(df):
    out = []
    for r in df.collect():
        similarity = None if r.similarity is None else round(r.similarity, 9)
        out.append((r.query_id, r["rank"], r.id, r.news_id, similarity))
    return sorted(out, key=repr)


def _chunks(spark, vectors):
    data = [(i, i % 7, None if v is None else [None if x is None else float(x) for x in v], f"t{i}") for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, CHUNKS)


def _queries(spark, vectors):
    return spark.createDataFrame(
        [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id bigint, embedding array<float>"
    )


def test_clustered_vectors_are_mostly_skipped(spark):
    points = _clustered(np.random.default_rng(1), 3060)
    chunks, queries = _chunks(spark, points[:3000]), _queries(spark, points[3000:])
    index = cells.build_cells(chunks, scratch(spark, "cells"), block_rows=64)
    for k in (5, 200):
        found = cells.nearest_pruned(index, queries, k)
        assert _rows(found.hits) == _rows(nearest_batch(chunks, queries, k))
        share = cells.share_scored(found.visits, index)
        assert share < (0.25 if k <= 5 else 0.5)
        assert found.visits.count() == found.visits.distinct().count()


def test_vectors_without_structure_give_the_same_hits(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(830, 8)).astype(np.float32) * rng.uniform(0.1, 9, (830, 1)).astype(np.float32)
    chunks, queries = _chunks(spark, points[:800]), _queries(spark, points[800:])
    index = cells.build_cells(chunks, scratch(spark, "cells"), cells=9, block_rows=50)
    found = cells.nearest_pruned(index, queries, 7)
    assert _rows(found.hits) == _rows(nearest_batch(chunks, queries, 7))


def test_awkward_vectors_and_queries(spark):
    rng = random.Random(3)

    def vector():
        return [rng.gauss(0, 1) for _ in range(4)]

    same = vector()
    vectors = [vector() for _ in range(60)] + [same] * 90 + [[2 * x for x in same]] * 5
    vectors += [None, [0.0] * 4, [math.nan, 0, 0, 1], [math.inf, 1, 1, 1], [-x for x in same], [0.0] * 4]
    chunks = _chunks(spark, vectors).unionByName(spark.createDataFrame([(None, 1, same, "x"), (3, 3, same, "y")], CHUNKS))
    queries = _queries(spark, [same, vector(), [0.0] * 4, None, [math.nan] * 4, [-x for x in same]])
    index = cells.build_cells(chunks, scratch(spark, "cells"), cells=5, block_rows=16)
    assert index.blocks.agg(F.max("rows")).first()[0] == 16
    for k in (5, 170):
        found = cells.nearest_pruned(index, queries, k)
        assert _rows(found.hits) == _rows(nearest_batch(chunks, queries, k))
    with pytest.raises(ValueError):
        cells.nearest_pruned(index, queries, 0)


@pytest.mark.parametrize("vectors", [[], [None], [[0.0, 0.0]], [[1.0, 2.0]]])
def test_small_indexes(spark, vectors):
    chunks, queries = _chunks(spark, vectors), _queries(spark, [[1.0, 1.0], [0.0, 0.0]])
    index = cells.build_cells(chunks, scratch(spark, "cells"))
    assert _rows(cells.nearest_pruned(index, queries).hits) == _rows(nearest_batch(chunks, queries))
    assert cells.nearest_pruned(index, queries.limit(0)).hits.count() == 0


def test_vectors_added_later(spark):
    points = _clustered(np.random.default_rng(4), 420)
    chunks, queries = _chunks(spark, points[:400]), _queries(spark, points[400:])
    folder = scratch(spark, "cells")
    cells.build_cells(chunks.where("id < 250"), folder, block_rows=32)
    index = cells.add_to_cells(chunks.where("id >= 250"), folder, block_rows=32)
    assert index.blocks.agg(F.sum("rows")).first()[0] == 400
    assert _rows(cells.nearest_pruned(index, queries).hits) == _rows(nearest_batch(chunks, queries))


def test_whole_search(spark):
    points = _clustered(np.random.default_rng(5), 130)
    chunks, queries = _chunks(spark, points[:100]), _queries(spark, points[100:])
    raw = spark.range(7).select("id", F.concat(F.lit("http://n/"), "id").alias("link"))
    index = cells.build_cells(chunks, scratch(spark, "cells"))

    def rows(df):
        return sorted(((r.query_id, r["rank"], r.id, r.chunk_text, r.link) for r in df.collect()))

    assert rows(cells.search_pruned(index, chunks, raw, queries)) == rows(search_top_k_batch(chunks, raw, queries))


def test_vectors_of_skipped_blocks_are_not_joined(spark):
    """Angles are read without vectors, and vectors only for blocks that are visited."""
    points = _clustered(np.random.default_rng(6), 200)
    index = cells.build_cells(_chunks(spark, points[:190]), scratch(spark, "cells"), block_rows=16)
    angles = index.blocks.select("cell", "low", "high", "rows", "block")._jdf.queryExecution().executedPlan().toString()
    assert "embeddings" not in angles
