"""Integer vectors in blocks of rows, and a query set against all of them.

Rows are dealt out evenly, whatever their ids, and written once as blocks of some thousand
rows: ids, labels, the integer vectors, and what an operator's index adds to them. A query
set then meets every block: blocks and bands of queries are paired by their numbers, so that
a task holds one block and one band, and no pair of rows is ever a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.session import materialize

#: Rows of a block, and queries of a band.
BLOCK_ROWS = 16384
BAND_ROWS = 512

_BLOCK = "block long, ids array<long>, labels array<int>, dim int, vectors binary"
_QUERY = "block long, place int, id long, label int, dim int, vector binary"

#: Largest integer inner product that is computed.
_LARGEST = 2**62


class Blocks(NamedTuple):
    table: DataFrame
    lanes: int  # block numbers modulo this are 0 to lanes - 1


def integers(lists: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole, and their components times `scale`, rounded down, as a matrix.

    A row is whole if neither it nor a component is null and all are finite. Shorter rows
    are filled up with zeros, which add nothing to an inner product.
    """
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    broken = np.bincount(owner, weights=~np.isfinite(flat), minlength=len(lengths)) > 0
    whole = np.flatnonzero(~broken & lists.is_valid().to_numpy(zero_copy_only=False))
    matrix = np.zeros((len(lengths), int(lengths[whole].max(initial=0))))
    kept = np.isin(owner, whole)
    place = np.arange(len(flat)) - (offsets[:-1] - offsets[0])[owner]
    matrix[owner[kept], place[kept]] = flat[kept]
    scaled = np.floor(matrix[whole] * scale)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component does not fit into an integer")
    return whole, scaled.astype(np.int64)


def inner_products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer query, over the places both have."""
    n = min(matrix.shape[1], len(query))
    if not matrix.size or not n:
        return np.zeros(len(matrix), np.int64)
    if int(np.abs(matrix).max()) * int(np.abs(query).max()) * n >= _LARGEST:
        raise ValueError("an inner product does not fit into a long")
    return matrix[:, :n] @ query[:n]


def as_bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def matrix_of(row: dict) -> np.ndarray:
    """The integer vectors of a block."""
    return np.frombuffer(row["vectors"], np.int64).reshape(len(row["ids"]), row["dim"])


def blocks_of(
    rows: DataFrame,
    id_: Column,
    vector: Column,
    scale: float,
    encode: Callable[[np.ndarray], dict],
    index_schema: str,
    label: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Blocks:
    """The rows with a whole vector, and with a label if one is named, as blocks.

    `encode` gets a block's integer matrix and gives the columns of `index_schema`. Rows of
    a block stand in the order of their labels.
    """
    rows = rows.select(
        id_.cast("long").alias("id"),
        (F.lit(None) if label is None else label).cast("int").alias("label"),
        vector.cast("array<double>").alias("vector"),
    ).where("vector is not null")
    if label is not None:
        rows = rows.where("label is not null")
    lanes = max(1, -(-rows.count() // block_rows))
    schema = f"{_BLOCK}, {index_schema}"
    names = [field.split()[0] for field in schema.split(", ")]

    def block(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(batches).combine_chunks()
        if not table.num_rows:
            return None
        whole, matrix = integers(table.column("vector").chunk(0), scale)
        if not len(whole):
            return None
        labels = table.column("label").take(pa.array(whole))
        order = np.argsort(labels.fill_null(0).to_numpy(), kind="stable")
        ids = table.column("id").take(pa.array(whole[order]))
        row = {
            "block": number,
            "ids": ids.to_pylist(),
            "labels": labels.take(pa.array(order)).to_pylist(),
            "dim": matrix.shape[1],
            "vectors": as_bytes(matrix[order]),
        } | encode(matrix[order])
        return pa.RecordBatch.from_pylist([{name: row[name] for name in names}], arrow)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= block_rows:
                made = block(held, number)
                held, count, number = [], 0, number + lanes
                if made:
                    yield made
        if held and (made := block(held, number)):
            yield made

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    # dealt out in turn: no id, label or vector gathers in one task
    return Blocks(materialize(rows.repartition(lanes).mapInArrow(build, schema), "blocks"), lanes)


def queries_of(blocks: Blocks, every: int) -> DataFrame:
    """The rows whose id is divisible by `every`, each with the block and place it stands at."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = matrix_of(row)
                places = [i for i, x in enumerate(row["ids"]) if x is not None and x % every == 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(places), pa.int64()),
                        pa.array(places, pa.int32()),
                        pa.array([row["ids"][i] for i in places], pa.int64()),
                        pa.array([row["labels"][i] for i in places], pa.int32()),
                        pa.array([row["dim"]] * len(places), pa.int32()),
                        pa.array([as_bytes(matrix[i]) for i in places], pa.binary()),
                    ],
                    ["block", "place", "id", "label", "dim", "vector"],
                )

    table = blocks.table.select("block", "ids", "labels", "dim", "vectors")
    return materialize(table.mapInArrow(pick, _QUERY), "queries")


def against_all(
    blocks: Blocks,
    queries: DataFrame,
    search: Callable[[dict, list[dict]], Iterator[tuple]],
    schema: str,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """What `search` gives for every block with every band of queries."""
    bands = max(1, -(-queries.count() // band_rows))
    names = [field.split()[0] for field in schema.split(", ")]
    arrow = to_arrow_schema(queries.sparkSession.createDataFrame([], schema).schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right.sort_by([("block", "ascending"), ("place", "ascending")]).to_pylist()
        found: list[list] = [[] for _ in names]
        for batch in left.to_batches(1):
            for row in batch.to_pylist() if asked else []:
                for result in search(row, asked):
                    for column, value in zip(found, result):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, arrow)], schema=arrow)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = blocks.table.select("*", F.pmod("block", F.lit(blocks.lanes)).cast("int").alias("lane"), every(bands).alias("band"))
    right = queries.select(
        "*", every(blocks.lanes).alias("lane"), F.pmod(F.xxhash64("block", "place"), F.lit(bands)).cast("int").alias("band")
    )
    keys = ["lane", "band"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
