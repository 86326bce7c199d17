"""Hard-negative mining on rotated one-bit codes.

Every vector is turned by a fixed rotation (random signs and a Hadamard transform) and kept
as one bit a dimension: the sign. Beside the code stands its alignment with the vector, the
length of the vector along the code. What the code leaves over is coded in the same way by
another rotation, a few times, and the length of the last remainder is stored as well.

The inner product with a query is then estimated by popcounts of the codes with the bit
planes of the rotated query, weighed by the alignments. By the Cauchy-Schwarz inequality the
remainder can add no more than its length times the query's; with the bound on what the
planes leave out that gives an interval which holds the true score for certain. Rows whose
interval cannot matter are out; the others get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
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
from newsloom.session import materialize

SCALE = 256.0
#: Codes of a vector, and bit planes of a rotated query.
CODES = 4
PLANES = 7
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90

_INDEX = "codes binary, alignments binary, rest binary"
_POSITIVE = "block long, place int, anchor_id long, positive_id long, positive_score long"
_NEGATIVE = f"{_POSITIVE}, nth int, negative_id long, negative_score long"
#: Part of a product by which sums of doubles may be off; they are off by less than a thousandth of it.
_ROUNDING = 1e-9


def turned(rows: np.ndarray, turn: int) -> np.ndarray:
    """The rows under the rotation of that number, times the root of the width: signs from a
    fixed generator, then a Hadamard transform over a power of two from 64 on."""
    n, dim = rows.shape
    width = max(64, 1 << (dim - 1).bit_length() if dim else 0)
    signs = np.random.default_rng(turn + 1).integers(0, 2, width) * 2 - 1
    out = np.zeros((n, width), rows.dtype)
    out[:, :dim] = rows * signs[:dim].astype(rows.dtype)
    step = 1
    while step < width:
        pairs = out.reshape(n, width // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return out


def turned_back(rows: np.ndarray, turn: int, dim: int) -> np.ndarray:
    """The inverse of `turned`, times the width."""
    width = rows.shape[1]
    signs = np.random.default_rng(turn + 1).integers(0, 2, width) * 2 - 1
    out, step = rows, 1
    while step < width:
        pairs = out.reshape(len(rows), width // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows.shape)
        step *= 2
    return out * signs


def encoded(matrix: np.ndarray, codes: int = CODES) -> dict:
    """The index of a block: codes (code, word, row), alignments (code, row) and the length
    of what is left over of each row."""
    n, dim = matrix.shape
    width = max(64, 1 << (dim - 1).bit_length() if dim else 0)
    rest = np.zeros((n, width))
    rest[:, :dim] = matrix
    words, alignments = [], []
    for turn in range(codes):
        along = turned(rest, turn)
        positive = along >= 0
        alignment = np.abs(along).sum(axis=1) / (float(width) * width)
        rest = rest - alignment[:, None] * turned_back(np.where(positive, 1.0, -1.0), turn, dim)
        words.append(np.packbits(positive, axis=1, bitorder="little").view(np.uint64).T)
        alignments.append(alignment)
    return {
        "codes": as_bytes(np.array(words)),
        "alignments": as_bytes(np.array(alignments)),
        "rest": as_bytes(np.sqrt(np.einsum("ij,ij->i", rest, rest))),
    }


class Coded:
    """A block with its codes."""

    def __init__(self, row: dict, codes: int = CODES, planes: int = PLANES):
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
        self.nulls = np.array([i is None for i in row["ids"]])
        self.labels = np.array(row["labels"], np.int64)
        self.matrix, self.turns, self.planes = matrix_of(row), codes, planes
        n = len(self.ids)
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(codes, -1, n)
        self.alignments = np.frombuffer(row["alignments"], np.float64).reshape(codes, n)
        self.rest = np.frombuffer(row["rest"], np.float64)
        self.length = np.sqrt((self.matrix.astype(np.float64) ** 2).sum(axis=1))
        # twice the ones of a code, less its width: the sum of its signs
        width = 64 * self.codes.shape[1]
        self.signs = 2 * np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64) - width

    def fitted(self, vector: np.ndarray) -> np.ndarray:
        out = np.zeros(self.matrix.shape[1], np.int64)
        n = min(len(out), len(vector))
        out[:n] = vector[:n]
        return out

    def interval(self, query: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the scores of the rows in `part`, and by how much they may be off."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        estimate = np.zeros(len(self.rest[part]))
        error = self.rest[part] * length + _ROUNDING * (self.length[part] * length + 1)
        half = 1 << (self.planes - 1)
        for turn in range(self.turns):
            along = turned(query[None, :], turn)[0]
            shift = max(0, int(np.abs(along).max()).bit_length() - self.planes + 1)
            lowest, highest = -half, half - 1
            coarse = np.clip((along + (1 << shift >> 1)) >> shift, lowest, highest)
            left_out = int(np.abs(along - (coarse << shift)).sum())
            shifted = coarse + half
            ones = np.zeros(len(estimate), np.int64)
            for plane in range(self.planes):
                bits = np.packbits((shifted >> plane) & 1 == 1, bitorder="little").view(np.uint64)
                for word, mask in zip(self.codes[turn][:, part], bits):
                    ones += np.bitwise_count(word & mask).astype(np.int64) << plane
            signed = 2 * ones - int(shifted.sum()) - half * self.signs[turn, part]
            weight = self.alignments[turn, part]
            estimate += weight * (signed << shift)
            error += weight * left_out
        return estimate, error

    def best(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Order of the `k` highest scores, ties to the smaller id, null ids last."""
        return np.lexsort((self.nulls[places], self.ids[places], -scores))[:k]

    def id_at(self, place: int) -> int | None:
        return None if self.nulls[place] else int(self.ids[place])


def _kth(values: np.ndarray, k: int) -> float:
    return -np.inf if len(values) < k else np.partition(values, len(values) - k)[len(values) - k]


def positives_in(row: dict, anchors: list[dict], k: int) -> Iterator[tuple]:
    """The `k` best rows of an anchor's own label in a block."""
    block = Coded(row)
    for anchor in anchors:
        lo, hi = np.searchsorted(block.labels, [anchor["label"], anchor["label"] + 1])
        if lo == hi:
            continue
        vector = block.fitted(np.frombuffer(anchor["vector"], np.int64))
        estimate, error = block.interval(vector, slice(lo, hi))
        if anchor["block"] == row["block"]:
            estimate[anchor["place"] - lo] = -np.inf
        floor = _kth(estimate - error, k)
        near = lo + np.flatnonzero((estimate + error >= floor) & (estimate > -np.inf))
        scores = inner_products(block.matrix[near], vector)
        for i in block.best(near, scores, k):
            yield anchor["block"], anchor["place"], anchor["id"], block.id_at(near[i]), int(scores[i])


def negatives_in(row: dict, anchors: list[dict], k: int, low: int, high: int) -> Iterator[tuple]:
    """The `k` best rows of other labels in each positive's band in a block."""
    block = Coded(row)
    for anchor in anchors:
        bands = [
            (p, -(-low * p["score"] // 100), high * p["score"] // 100)
            for p in anchor["positives"]
            if low * p["score"] <= high * p["score"]
        ]
        if not bands:
            continue
        vector = block.fitted(np.frombuffer(anchor["vector"], np.int64))
        estimate, error = block.interval(vector, slice(None))
        lo, hi = np.searchsorted(block.labels, [anchor["label"], anchor["label"] + 1])
        other = np.ones(len(estimate), bool)
        other[lo:hi] = False
        lower, upper = np.where(other, estimate - error, np.inf), np.where(other, estimate + error, -np.inf)
        # a few rows that look best are scored first: what they reach, others must reach too
        top = max(b for _, _, b in bands)
        likely = np.where(other & (estimate <= top), estimate, -np.inf)
        first = np.argpartition(likely, -min(8 * k, len(likely)))[-min(8 * k, len(likely)) :]
        first = first[other[first]]
        tried = inner_products(block.matrix[first], vector)
        wanted = np.zeros(len(estimate), bool)
        for _, a, b in bands:
            floor = max(a, _kth(tried[(tried >= a) & (tried <= b)], k))
            wanted |= (upper >= floor) & (lower <= b)
        near = np.flatnonzero(wanted)
        scores = inner_products(block.matrix[near], vector)
        for positive, a, b in bands:
            fit = np.flatnonzero((scores >= a) & (scores <= b))
            for i in block.best(near[fit], scores[fit], k):
                yield (
                    anchor["block"], anchor["place"], anchor["id"], positive["id"], positive["score"],
                    positive["nth"], block.id_at(near[fit][i]), int(scores[fit][i]),
                )


def mine_hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    every: int = EVERY,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
    block_rows: int = BLOCK_ROWS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are its
    best other rows of the same label; a positive's negatives are the best rows of other
    labels whose score is `low` to `high` hundredths of the positive's. Ties go to the
    smaller id, null ids come last. A positive without any such row gives none, nor does
    one with a negative score.

    Rows with a null label or vector, or a null or endless component, take no part. Shorter
    vectors count as filled up with zeros. A row with a null id is no anchor, but may be
    found. Rows that repeat an id are rows of their own: each is an anchor and finds the
    others. An empty table gives an empty result; other columns are not looked at.
    """
    if min(positives, negatives, every) < 1 or not 0 <= low <= high:
        raise ValueError("counts must be positive and 0 <= low <= high")
    blocks = blocks_of(
        vectors,
        column(id_col),
        column(vector_col),
        scale,
        encoded,
        _INDEX,
        column(label) if isinstance(label, str) else label,
        block_rows,
    )
    anchors = queries_of(blocks, every)
    near = against_all(blocks, anchors, lambda row, asked: positives_in(row, asked, positives), _POSITIVE, band_rows)
    rank = Window.partitionBy("block", "place").orderBy(
        F.desc("positive_score"), F.col("positive_id").asc_nulls_last()
    )
    best = near.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= positives)
    pairs = F.struct("nth", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    # at most `positives` rows an anchor
    chosen = best.groupBy("block", "place").agg(F.sort_array(F.collect_list(pairs)).alias("positives"))
    asked = materialize(anchors.join(chosen, ["block", "place"]), "anchors")

    far = against_all(
        blocks, asked, lambda row, asked: negatives_in(row, asked, negatives, low, high), _NEGATIVE, band_rows
    )
    rank = Window.partitionBy("block", "place", "nth").orderBy(
        F.desc("negative_score"), F.col("negative_id").asc_nulls_last()
    )
    return (
        far.withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
