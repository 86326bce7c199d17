"""Exact nearest-chunk search that skips most vectors.

Vectors are grouped around centroids, and the vectors of a cell are stored in order of
their angle to its centroid, some thousand to a block. A block keeps the least and the
greatest of these angles beside its vectors. Angles between directions obey the triangle
inequality, so that the angle of a query to the centroid says how near any vector of a
block can be. A query first looks into the blocks that may hold the nearest vectors; with
the k-th similarity found there, every block that cannot reach it is skipped. What is
skipped is never nearer, so that the hits are those of a full scan.

An index is a folder of two tables: `centroids`, and `blocks` with one row per block, whose
angles can be read without its vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window, WindowSpec

from newsloom import fixed_values as fv
from newsloom.functions import vectors
from newsloom.functions.sizes import measure
from newsloom.operators.search import attach_chunks, attach_links, hit_columns
from newsloom.session import materialize

#: Vectors of a block, and queries that meet a block in one task.
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
#: Most cells; their centroids go to every task.
MAX_CELLS = 1024
#: Vectors for each cell that the centroids are fitted on.
FIT_ROWS = 256

#: Cell of the vectors without a direction.
_NOWHERE = -1
#: Angles are computed to about 1e-8; bounds give way by more.
_SLACK = 1e-6

_PLACED = "cell int, angle double, id bigint, news_id bigint, embedding array<float>"
_BLOCKS = (
    "cell int, low double, high double, rows int, block string, ids array<bigint>, news_ids array<bigint>, "
    "dim int, embeddings binary"
)


class CellIndex(NamedTuple):
    centroids: DataFrame  # cell, centroid
    blocks: DataFrame


class PrunedHits(NamedTuple):
    hits: DataFrame  # query_id, id, news_id, similarity, rank
    visits: DataFrame  # query_id, block, rows: what was scored


def _unit(embeddings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions in double precision, and which rows have one."""
    rows = embeddings.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = vectors.norms(rows)
    directed = np.isfinite(lengths) & (lengths > 0)
    rows[~directed] = 0.0
    return rows / np.where(directed, lengths, 1.0)[:, None], directed


def _angles(directions: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ centroids.T, -1.0, 1.0))


def _centroids(index: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their centroids, at most `MAX_CELLS`."""
    rows = index.orderBy("cell").limit(MAX_CELLS).collect()
    return np.array([r["cell"] for r in rows], np.int32), np.array([r["centroid"] for r in rows], np.float64)


def _stored(chunks: DataFrame) -> DataFrame:
    return chunks.where("id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("id").cast("bigint"), F.col("news_id").cast("bigint"), F.col("embedding").cast("array<float>")
    )


def fit_centroids(chunks: DataFrame, cells: int | None = None, seed: int = 1) -> DataFrame:
    """`cell, centroid`: unit vectors fitted by k-means on at most `FIT_ROWS` vectors a cell,
    those with the least hash of their id. They decide how much is skipped, never what is found."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    length = F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x * x)
    directed = _stored(chunks).select("id", numbers.alias("v"), length.alias("length")).where(
        "length > 0 AND length < double('infinity') AND NOT isnan(length)"
    )
    if cells is None:
        cells = int(np.sqrt(chunks.count()) / 2)
    cells = min(max(cells, 2), MAX_CELLS)  # k-means takes two at least
    sample = directed.orderBy(F.xxhash64("id"), "id").limit(cells * FIT_ROWS).select(array_to_vector("v").alias("features"))
    sample = materialize(sample.select("features"), "fit")
    schema = "cell int, centroid array<double>"
    if sample.isEmpty():
        return chunks.sparkSession.createDataFrame([], schema)
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
    centers = [np.asarray(c, np.float64) for c in model.clusterCenters()]
    rows = [(i, (c / np.sqrt(c @ c)).tolist()) for i, c in enumerate(centers) if c @ c > 0]
    return chunks.sparkSession.createDataFrame(rows, schema)


def _placed(chunks: DataFrame, centroids: DataFrame) -> DataFrame:
    """Vectors with the nearest centroid and the angle to it."""
    cells, matrix = _centroids(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            directions, directed = _unit(vectors.matrix(batch.column("embedding")))
            cell = np.full(batch.num_rows, _NOWHERE, np.int32)
            angle = np.zeros(batch.num_rows)
            if len(cells):
                angles = _angles(directions, matrix)
                nearest = angles.argmin(axis=1)
                cell = np.where(directed, cells[nearest], cell).astype(np.int32)
                angle = np.where(directed, angles[np.arange(len(angles)), nearest], 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), *batch.columns], names)

    names = ["cell", "angle", "id", "news_id", "embedding"]
    return _stored(chunks).mapInArrow(place, _PLACED)


def _blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """Vectors in order of cell and angle, `block_rows` to a row. The order is cut by range, so
    that a cell of very many vectors is spread over tasks."""
    arrow = to_arrow_schema(placed.sparkSession.createDataFrame([], _BLOCKS).schema)
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def block(rows: pa.Table) -> pa.RecordBatch:
        angles = rows.column("angle").to_numpy()
        ids = rows.column("id").to_pylist()
        embeddings = vectors.matrix(rows.column("embedding"))
        made = {
            "cell": rows.column("cell")[0].as_py(),
            "low": float(angles.min()),
            "high": float(angles.max()),
            "rows": len(ids),
            "block": uuid.uuid4().hex,
            "ids": ids,
            "news_ids": rows.column("news_id").to_pylist(),
            "dim": embeddings.shape[1],
            "embeddings": np.ascontiguousarray(embeddings, np.float32).tobytes(),
        }
        return pa.RecordBatch.from_pylist([made], arrow)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, cell = [], 0, None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if count and (cells[lo] != cell or count == block_rows):
                        yield block(pa.Table.from_batches(held))
                        held, count = [], 0
                    cell, size = cells[lo], min(hi - lo, block_rows - count)
                    held.append(batch.slice(lo, size))
                    lo, count = lo + size, count + size
        if count:
            yield block(pa.Table.from_batches(held))

    order = ["cell", "angle", "id"]
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(gather, _BLOCKS)


def build_cells(chunks: DataFrame, folder: str, cells: int | None = None, block_rows: int = BLOCK_ROWS) -> CellIndex:
    """Write the index of all vectors of `chunks` (`id, news_id, embedding`) to a new folder."""
    spark, folder = chunks.sparkSession, folder.rstrip("/")
    fit_centroids(chunks, cells).coalesce(1).write.parquet(f"{folder}/centroids")
    index = CellIndex(spark.read.parquet(f"{folder}/centroids"), None)
    # sampling for the range would place every vector twice
    placed = materialize(_placed(chunks, index.centroids), "placed")
    _blocks(placed, block_rows).write.parquet(f"{folder}/blocks")
    return open_cells(spark, folder)


def add_to_cells(chunks: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> CellIndex:
    """Add vectors to an index: they go to the cells that are there, in blocks of their own."""
    index = open_cells(chunks.sparkSession, folder)
    placed = materialize(_placed(chunks, index.centroids), "placed")
    _blocks(placed, block_rows).write.mode("append").parquet(f"{folder.rstrip('/')}/blocks")
    return open_cells(chunks.sparkSession, folder)


def open_cells(spark: SparkSession, folder: str) -> CellIndex:
    folder = folder.rstrip("/")
    return CellIndex(spark.read.parquet(f"{folder}/centroids"), spark.read.parquet(f"{folder}/blocks"))


def _query_cells(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """`query_id, cell, angle`: every query with every cell; the angle is null for the cell of
    vectors without a direction, and for queries without one."""
    cells, matrix = _centroids(centroids)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.append(cells, np.int32(_NOWHERE))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                directions, directed = _unit(vectors.matrix(part.column("embedding")))
                angles = np.full((part.num_rows, len(known)), np.nan)
                if len(cells):
                    angles[:, :-1] = np.where(directed[:, None], _angles(directions, matrix), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column("query_id").to_numpy(), len(known))),
                        pa.array(np.tile(known, part.num_rows)),
                        pa.array(angles.ravel(), mask=np.isnan(angles.ravel())),
                    ],
                    ["query_id", "cell", "angle"],
                )

    return queries.select("query_id", "embedding").mapInArrow(cross, "query_id bigint, cell int, angle double")


def _nearest_possible(low: str, high: str) -> Column:
    """Least angle that a vector of a block, or of a cell, can have with a query; null if the
    similarity of one of them is undefined."""
    apart = F.greatest(F.lit(0.0), F.col("angle") - F.col(high), F.col(low) - F.col("angle")) - _SLACK
    return F.when(F.col("angle").isNotNull(), F.greatest(F.lit(0.0), apart))


def _score(index: CellIndex, pairs: DataFrame, queries: DataFrame, k: int, bands: int) -> DataFrame:
    """The best k of each block for the queries that visit it. A block that very many queries
    visit meets them in bands of bounded size."""
    band = F.pmod(F.xxhash64("query_id"), F.lit(bands)).cast("int").alias("band")
    asking = pairs.select("query_id", "block").join(queries, "query_id").select("*", band)
    # vectors are read for the visited blocks alone
    wanted = pairs.select("block", band).distinct()
    rows = index.blocks.select("block", "ids", "news_ids", "dim", "embeddings").join(wanted, "block")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        top = vectors.TopK([], np.empty((0, 1)), k)
        if left.num_rows and right.num_rows:
            asked = right.sort_by("query_id")
            top = vectors.TopK(asked.column("query_id").to_numpy(), vectors.matrix(asked.column("embedding")), k)
            for row in left.to_pylist():
                values = pa.array(np.frombuffer(row["embeddings"], np.float32))
                offsets = pa.array(np.arange(len(row["ids"]) + 1, dtype=np.int32) * row["dim"])
                top.add(
                    pa.array(row["ids"], pa.int64()), pa.array(row["news_ids"], pa.int64()),
                    pa.ListArray.from_arrays(offsets, values),
                )
        return pa.Table.from_batches([top.result()])

    keys = ["block", "band"]
    return rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(score, vectors.TOP_K_SCHEMA)


def nearest_pruned(index: CellIndex, queries: DataFrame, k: int = fv.TOP_K) -> PrunedHits:
    """The hits of `search.nearest_batch`, from an index and in fewer scores, and which blocks
    each query visited.

    A query without a direction visits everything, as all its similarities are undefined.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = materialize(
        queries.where(F.col("embedding").isNotNull()).select(
            F.col("query_id").cast("bigint"), F.col("embedding").cast("array<float>")
        ),
        "asked",
    )
    bands = max(1, -(-measure(asked.select("query_id"))[0] // QUERY_ROWS))
    blocks = materialize(index.blocks.select("cell", "low", "high", "rows", "block"), "angles")
    cells = blocks.groupBy("cell").agg(F.min("low").alias("cell_low"), F.max("high").alias("cell_high"), F.sum("rows").alias("cell_rows"))
    angles = materialize(_query_cells(asked, index.centroids).join(F.broadcast(cells), "cell"), "query-cells")

    # where the nearest vectors may be: the cells that come nearest, and in them the blocks that
    # do, until k vectors are seen
    def before(rows: str, window: WindowSpec) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(rows).over(earlier), F.lit(0))

    by_cell = Window.partitionBy("query_id").orderBy(
        _nearest_possible("cell_low", "cell_high").asc_nulls_last(), F.col("angle").asc_nulls_last(), "cell"
    )
    nearest = angles.withColumn("before", before("cell_rows", by_cell)).where(F.col("before") < k)
    in_reach = Window.partitionBy("query_id").orderBy(_nearest_possible("low", "high").asc_nulls_last(), "low", "block")
    first = materialize(
        nearest.join(blocks, "cell")
        .withColumn("before", before("rows", in_reach))
        .where(F.col("before") < k)
        .select("query_id", "block", "rows"),
        "first",
    )
    early = materialize(_score(index, first, asked, k, bands), "early")
    kth = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    floors = early.withColumn("nth", F.row_number().over(kth)).where(F.col("nth") == k).select(
        "query_id", F.col("similarity").alias("floor")
    )

    def can_reach(low: str, high: str) -> Column:
        """Undefined similarities come last: they matter while there is no k-th, or it is undefined."""
        best = F.cos(_nearest_possible(low, high))
        return F.col("floor").isNull() | (best >= F.col("floor") - _SLACK)

    left = (
        angles.join(floors, "query_id", "left")
        .where(can_reach("cell_low", "cell_high"))
        .join(blocks, "cell")
        .where(can_reach("low", "high"))
        .select("query_id", "block", "rows")
        .join(first, ["query_id", "block"], "left_anti")
    )
    left = materialize(left, "left")
    found = early.unionByName(_score(index, left, asked, k, bands))
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    hits = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return PrunedHits(hits, first.unionByName(left))


def search_pruned(
    index: CellIndex, chunks: DataFrame, raw: DataFrame, queries: DataFrame, k: int = fv.TOP_K
) -> DataFrame:
    """`search.search_top_k_batch` over an index of the vectors of `chunks`: the same rows."""
    hits = materialize(nearest_pruned(index, queries, k).hits, "hits")
    max_hits = hits.count()
    return hit_columns(attach_links(attach_chunks(hits, chunks, max_hits), raw, max_hits, ids=hits))


def share_scored(visits: DataFrame, index: CellIndex) -> float:
    """Part of all (query, vector) pairs that was scored."""
    seen = visits.agg(F.sum("rows"), F.countDistinct("query_id")).first()
    stored = index.blocks.agg(F.sum("rows")).first()[0]
    return float(seen[0] or 0) / max(1, (stored or 0) * seen[1])
