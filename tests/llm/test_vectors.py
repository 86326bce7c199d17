"""Top-k search and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import bitsliced, negatives, queries, vector_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, block int, score string, vectors string"


def _whole(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def _integers(vector):
    return [math.floor(256 * x) for x in vector]


def _score(a, b):
    return sum(x * y for x, y in zip(a, b))


def _last(i):
    return (i is None, i or 0)


def brute_top(rows, k=5, every=50):
    whole = [(r[0], _integers(r[1])) for r in rows if _whole(r[1])]
    out = []
    for at, (i, v) in enumerate(whole):
        if i is not None and i % every == 0:
            others = [(-_score(v, w), _last(j), j) for n, (j, w) in enumerate(whole) if n != at]
            out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(sorted(others)[:k])]
    return sorted(out, key=repr)


def brute_negatives(rows, every=100):
    whole = [(r[0], _integers(r[1]), r[2]) for r in rows if _whole(r[1]) and r[2] is not None]
    out = []
    for at, (i, v, label) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = sorted((-_score(v, w), _last(j), j, other) for n, (j, w, other) in enumerate(whole) if n != at)
        for p, _, pid, _ in [s for s in scored if s[3] == label][:5]:
            fit = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, pid, n + 1, s[2], -p, -s[0]) for n, s in enumerate(fit)]
    return sorted(out, key=repr)


def _found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _awkward():
    rng = random.Random(3)

    def vector(n=10):
        return [round(rng.gauss(0, 0.4), 2) for _ in range(n)]

    rows = [(i, vector(), rng.randrange(3)) for i in range(300)]
    same = vector()
    rows += [(300 + i, same, i % 3) for i in range(120)]  # ties
    rows += [(500, None, 1), (550, [0.1, None], 1), (600, [math.nan] * 10, 1), (650, [0.5, math.inf], 2)]
    rows += [(700, [], 0), (800, vector(4), 1), (900, vector(70), 2), (1000, same, None), (1100, [0.0] * 10, 2)]
    rows += [(None, same, 1), (None, vector(), 2), (None, None, None), rows[100], rows[100], (-100, vector(), 0), (-50, same, 1)]
    return [(*r, 1, "x", "y") for r in rows]


@pytest.mark.parametrize("block_rows, band_rows, slices", [(16384, 512, 6), (64, 3, 2), (50, 1, 30)])
def test_top_k_on_awkward_rows(spark, block_rows, band_rows, slices):
    rows = _awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = _found(bitsliced.exact_top_k(df, block_rows=block_rows, band_rows=band_rows, slices=slices))
    assert got == brute_top(rows)


@pytest.mark.parametrize("block_rows, band_rows", [(16384, 512), (64, 2)])
def test_negatives_on_awkward_rows(spark, block_rows, band_rows):
    rows = _awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = _found(negatives.mine_hard_negatives(df, block_rows=block_rows, band_rows=band_rows))
    assert got == brute_negatives(rows) and len(got) > 50


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in _awkward()[:1]], "vec_id long, embedding array<float>, label int")
    assert _found(bitsliced.exact_top_k(df)) == [] == _found(negatives.mine_hard_negatives(df))
    rows = [(0, [0.1, 0.9], 1), (1, [0.2, 0.8], 1), (2, [0.3, 0.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert _found(bitsliced.exact_top_k(df)) == brute_top(rows)
    assert _found(negatives.mine_hard_negatives(df)) == brute_negatives(rows)


@pytest.mark.parametrize("table", [[], [(50, None, 1, 1, "", "")], [(100, [None], None, 1, "", "")]])
def test_nothing_to_search(spark, table):
    df = spark.createDataFrame(table, SCHEMA)
    assert bitsliced.exact_top_k(df).collect() == []
    assert negatives.mine_hard_negatives(df).collect() == []


def test_registered_queries_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert _found(queries.QUERIES["op12_bitsliced_top_k"](spark, folder)) == brute_top(rows)
    rows = [(i, v, (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in rows]
    assert _found(queries.QUERIES["op13_hard_negatives"](spark, folder)) == brute_negatives(rows)


def test_layout_does_not_show(spark):
    df = spark.createDataFrame(_awkward(), SCHEMA)
    for build in (bitsliced.exact_top_k, negatives.mine_hard_negatives):
        assert _found(build(df.repartition(1))) == _found(build(df.orderBy(F.desc("vec_id")).repartition(7)))


def test_sums_on_slices():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-300, 300, (500, 7))
    for weights in (rng.integers(-260, 260, 7), np.zeros(7, np.int64), np.array([-1, 0, 1, -256, 256, 3, 0])):
        index = bitsliced.sliced(matrix, 12)
        assert index["cut"] == 0
        plain = np.frombuffer(index["planes"], np.uint64).reshape(-1, 7, 8)
        total = bitsliced.weighted_sum(np.concatenate([plain, ~plain], axis=1), weights)
        sums = sum(
            np.unpackbits(t.view(np.uint8), bitorder="little")[:500].astype(np.int64) << i for i, t in enumerate(total)
        )
        scores = matrix @ weights
        assert (np.diff(scores) == np.diff(sums)).all()
        rows = bitsliced.bitmap(np.ones((1, 500), bool))[0]
        for k in (1, 5, 500):
            value = bitsliced.kth_largest(total, rows, k)
            assert value == sorted(sums)[-k]
            chosen = np.unpackbits(bitsliced.at_least(total, rows, value).view(np.uint8), bitorder="little")[:500]
            assert (chosen == (sums >= value)).all()


@pytest.mark.parametrize("dim", [1, 10, 64, 100])
def test_intervals_hold_the_score(dim):
    rng = np.random.default_rng(dim)
    matrix = np.concatenate([rng.integers(-256, 257, (200, dim)), np.zeros((1, dim), np.int64)])
    row = {"ids": list(range(201)), "labels": [0] * 201, "dim": dim, "vectors": vector_blocks.as_bytes(matrix)}
    block = negatives.Coded(row | negatives.encoded(matrix))
    for query in (*matrix[:20], matrix[-1], rng.integers(-100_000, 100_000, dim)):
        estimate, error = block.interval(query, slice(None))
        scores = matrix @ query
        assert (np.abs(scores - estimate) <= error).all()
    estimate, error = block.interval(matrix[0], slice(None))
    lengths = np.sqrt((matrix**2).sum(axis=1) * (matrix[0] ** 2).sum())
    assert np.median(error[:-1] / lengths[:-1]) < 0.3  # one code alone leaves 0.6


def test_too_large_components(spark):
    df = spark.createDataFrame([(50, [1e18]), (51, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        bitsliced.exact_top_k(df).collect()
