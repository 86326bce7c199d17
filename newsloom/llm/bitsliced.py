"""Exact top-k search on a bit-sliced index.

Every component is an attribute of integers. Its leading bits are kept as slices: bitmaps
with one bit a row. A query weighs the attributes, and the weighted sum of all of them is
computed on the slices alone: each set bit of a weight adds the attribute's slices at its
place, and carry-save adders in bitmap arithmetic bring all slices of one place down to one.
That gives the slices of every row's sum at once.

The k-th largest sum is read off from the most significant slice downward. What the bits
below the slices can add has a bound, so that rows whose sum falls short of the k-th by more
than the bound are out; the few on or above that border get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import column
from newsloom.llm.vector_blocks import (
    BAND_ROWS,
    BLOCK_ROWS,
    against_all,
    as_bytes,
    blocks_of,
    inner_products,
    matrix_of,
    queries_of,
)

SCALE = 256.0
#: Leading bits of an attribute that are kept as slices.
SLICES = 6
EVERY = 50
K = 5

_INDEX = "cut int, planes binary"
_FOUND = "block long, place int, query_id long, vec_id long, score long"


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, padded with zeros."""
    rows, n = bits.shape
    padded = np.zeros((rows, -(-n // 64) * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    padded[:, : packed.shape[1]] = packed
    return padded.view(np.uint64)


def sliced(matrix: np.ndarray, slices: int = SLICES) -> dict:
    """The index of a block: the slices (slice, attribute, word) of every component above
    its least value in the block, without its `cut` lowest bits."""
    above = matrix - matrix.min(axis=0, initial=0) if matrix.size else matrix
    bits = int(above.max(initial=0)).bit_length()
    cut = max(0, bits - slices)
    planes = [bitmap(((above >> b) & 1).T.astype(bool)) for b in range(cut, bits)]
    return {"cut": cut, "planes": as_bytes(np.array(planes, np.uint64))}


def weighted_sum(planes: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum of |weight| times attribute over all attributes, least significant
    first. `planes` holds every attribute twice: as it is, and complemented for negative
    weights, which counts down from the largest value instead."""
    dim = len(weights)
    size = np.abs(weights)
    row = np.where(weights < 0, dim, 0) + np.arange(dim)
    chosen = [row[(size >> b) & 1 == 1] for b in range(int(size.max(initial=0)).bit_length())]
    words = planes.shape[2]
    total, carried, place = [], [], 0
    while place < len(chosen) + len(planes) - 1 or carried:
        terms = carried + [
            planes[place - b][rows] for b, rows in enumerate(chosen) if 0 <= place - b < len(planes) and len(rows)
        ]
        stack = np.concatenate(terms) if terms else np.zeros((1, words), np.uint64)
        carried = []
        while len(stack) > 2:
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            stack = np.concatenate([odd ^ c, stack[3 * third :]])
        if len(stack) == 2:
            carried.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        total.append(stack[0])
        place += 1
    return total


def kth_largest(total: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among `rows` (a bitmap of at least k), from the top slice down."""
    value, higher, level = 0, 0, rows
    for place in reversed(range(len(total))):
        ones = level & total[place]
        count = higher + int(np.bitwise_count(ones).sum())
        if count >= k:
            level, value = ones, value | 1 << place
        else:
            higher, level = count, level & ~total[place]
    return value


def at_least(total: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the `rows` whose sum is `bound` or more."""
    if bound <= 0:
        return rows
    if bound.bit_length() > len(total):
        return rows & np.uint64(0)
    more, level = rows & np.uint64(0), rows
    for place in reversed(range(len(total))):
        if bound >> place & 1:
            level = level & total[place]
        else:
            more, level = more | (level & total[place]), level & ~total[place]
    return more | level


def best_rows(planes: np.ndarray, cut: int, n: int, weights: np.ndarray, k: int, own: int | None = None) -> np.ndarray:
    """Places of all rows that can be among the `k` best of a block of `n`, ties included."""
    rows = bitmap(np.ones((1, n), bool))[0]
    if own is not None:
        rows[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        n -= 1
    if n > k and planes.size:
        total = weighted_sum(planes, weights)
        slack = ((1 << cut) - 1) * int(np.abs(weights).sum()) >> cut
        rows = at_least(total, rows, kth_largest(total, rows, k) - slack)
    return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))


def search_block(row: dict, queries: list[dict], k: int) -> Iterator[tuple]:
    """The `k` best rows of a block for every query, as rows of the result."""
    matrix, dim = matrix_of(row), row["dim"]
    n, words = len(row["ids"]), -(-len(row["ids"]) // 64)
    plain = np.frombuffer(row["planes"], np.uint64).reshape(-1, dim, words)
    planes = np.concatenate([plain, ~plain], axis=1)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
    nulls = np.array([i is None for i in row["ids"]])
    for query in queries:
        vector = np.frombuffer(query["vector"], np.int64)
        weights = np.zeros(dim, np.int64)
        weights[: min(dim, len(vector))] = vector[:dim]
        own = query["place"] if query["block"] == row["block"] else None
        near = best_rows(planes, row["cut"], n, weights, k, own)
        scores = inner_products(matrix[near], weights)
        for i in np.lexsort((nulls[near], ids[near], -scores))[:k]:
            yield query["block"], query["place"], query["id"], row["ids"][near[i]], int(scores[i])


def exact_top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    every: int = EVERY,
    scale: float = SCALE,
    slices: int = SLICES,
    block_rows: int = BLOCK_ROWS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows with the largest integer inner product for
    every row whose id is divisible by `every`, ties to the smaller id.

    Vectors that are null, or hold a null or endless component, take no part. Shorter
    vectors count as filled up with zeros, an empty one as all zeros. A row with a null id
    asks nothing, and is found last among equal scores. Rows that repeat an id are rows of
    their own: each asks, and finds the others, only itself is left out. An empty table
    gives an empty result; other columns are not looked at. An inner product beyond a long
    is an error.
    """
    if k < 1 or slices < 1:
        raise ValueError("k and slices must be positive")
    blocks = blocks_of(
        vectors, column(id_col), column(vector_col), scale, lambda m: sliced(m, slices), _INDEX, block_rows=block_rows
    )
    found = against_all(
        blocks, queries_of(blocks, every), lambda row, asked: search_block(row, asked, k), _FOUND, band_rows
    )
    best = Window.partitionBy("block", "place", "query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
