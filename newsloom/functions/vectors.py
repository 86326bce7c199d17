"""Cosine similarity: a column expression, and the Arrow kernel for large scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows are scored in tiles of about this many numbers against tiles of queries, so that
# the working set of a task stays small for any vector length.
_NUMBERS, _QUERIES = 1 << 20, 128


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column, normalized: bool = False) -> Column:
    """Cosine of two vectors as double, null if either is null or zero.

    `normalized=True` declares both to have unit length and skips the norms.
    """
    if normalized:
        return dot(a, b)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def matrix(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list<float> array without nulls as a (rows, dim) view."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    lengths = np.diff(offsets)
    if dim is None:
        dim = int(lengths[0]) if len(lengths) else 0
    if (lengths != dim).any():
        raise ValueError(f"different vector dimensions: expected {dim}, got {lengths[lengths != dim][0]}")
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return flat.reshape(len(lengths), dim)


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _directed(rows: np.ndarray) -> np.ndarray:
    """Norms; rows with a missing or endless element have no direction and become zero."""
    with np.errstate(over="ignore"):
        lengths = norms(rows)
    lost = ~np.isfinite(lengths)
    rows[lost], lengths[lost] = 0.0, 0.0
    return lengths


def _unit(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (rows / np.where(lengths > 0, lengths, 1.0)[:, None]).astype(np.float32)


def _cosine(rows, row_norms, query, query_norm) -> np.ndarray:
    """Similarity summed in one fixed order, so that equal vectors tie exactly."""
    scale = row_norms * query_norm
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 0, np.einsum("ij,j->i", rows, query) / scale, -np.inf)


_MISSING = np.iinfo(np.int64).min


class TopK:
    """Running exact top-k of every query over the batches one task reads.

    Order: similarity descending, undefined similarity last, then id ascending.
    A matrix product in single precision finds the rows that come near the k-th score;
    those are scored again, in double precision and in a fixed order, before they are
    kept.
    """

    def __init__(self, query_ids: Sequence[int], queries: np.ndarray, k: int):
        self.query_ids = np.asarray(query_ids, dtype=np.int64)
        self.queries = np.array(queries, dtype=np.float64)
        self.query_norms = _directed(self.queries)
        self.unit_queries = _unit(self.queries, self.query_norms)
        self.k = k
        # Above twice the rounding error of a single-precision product of unit vectors.
        self.slack = np.float32(4 * (self.queries.shape[1] + 8) * np.finfo(np.float32).eps)
        # Per query: ids, owners and scores of the best rows so far.
        nothing = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.best = [nothing] * len(self.query_ids)
        self.floors = np.full(len(self.query_ids), -np.inf)  # k-th score once there is one

    def add(self, ids: pa.Array, owners: pa.Array, embeddings: pa.Array) -> None:
        ids = ids.to_numpy()
        owners = owners.fill_null(_MISSING).to_numpy()
        vectors = matrix(embeddings, self.queries.shape[1])
        step = max(_NUMBERS // max(vectors.shape[1], 1), 1)
        for lo in range(0, len(vectors), step):
            part = slice(lo, lo + step)
            self._add(ids[part], owners[part], vectors[part].astype(np.float64))

    def _add(self, ids: np.ndarray, owners: np.ndarray, rows: np.ndarray) -> None:
        row_norms = _directed(rows)
        unit_rows = _unit(rows, row_norms).T
        no_direction = np.flatnonzero(row_norms == 0)
        for lo in range(0, len(self.query_ids), _QUERIES):
            part = slice(lo, lo + _QUERIES)
            rough = self.unit_queries[part] @ unit_rows
            rough[:, no_direction] = -np.inf
            rough[self.query_norms[part] == 0, :] = -np.inf
            passed = rough >= (self.floors[part, None] - self.slack).astype(np.float32)
            for j in np.flatnonzero(passed.any(axis=1)):
                near = self._near(rough[j], np.flatnonzero(passed[j]))
                query, length = self.queries[lo + j], self.query_norms[lo + j]
                scores = _cosine(rows[near], row_norms[near], query, length)
                self._keep(lo + j, ids[near], owners[near], scores)

    def _near(self, rough: np.ndarray, passed: np.ndarray) -> np.ndarray:
        """Those of the rows that passed the k-th score so far which can still be among
        the best k of this batch."""
        if len(passed) <= self.k:
            return passed
        scores = rough[passed]
        floor = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
        return passed[scores >= floor - self.slack]

    def _keep(self, i: int, ids: np.ndarray, owners: np.ndarray, scores: np.ndarray) -> None:
        merged = [np.concatenate(pair) for pair in zip(self.best[i], (ids, owners, scores))]
        order = np.lexsort((merged[0], -merged[2]))[: self.k]
        self.best[i] = tuple(column[order] for column in merged)
        if len(order) == self.k:
            self.floors[i] = merged[2][order[-1]]

    def result(self) -> pa.RecordBatch:
        counts = [len(best[0]) for best in self.best]
        nothing = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        ids, owners, scores = (np.concatenate(c) for c in zip(nothing, *self.best))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.query_ids, counts)),
                pa.array(ids),
                pa.array(owners, mask=owners == _MISSING),
                pa.array(scores, mask=np.isneginf(scores)),
            ],
            ["query_id", "id", "news_id", "similarity"],
        )


TOP_K_SCHEMA = "query_id bigint, id bigint, news_id bigint, similarity double"


def top_k_scan(
    query_ids: Sequence[int], queries: np.ndarray, k: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`mapInArrow` function over (id, news_id, embedding): at most k rows per query
    and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(query_ids, queries, k)
        for batch in batches:
            if batch.num_rows:
                top.add(*batch.columns)
        yield top.result()

    return scan
