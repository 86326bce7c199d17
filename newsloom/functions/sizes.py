"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest measured side that is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024

# Most ids that are written into a plan as literals, where the caller's limit proves them few.
LITERAL_IDS = 200


def with_ids(df: DataFrame, column: str, ids: Iterable[int | None]) -> DataFrame:
    """Rows with one of a few ids, as a filter that the Parquet reader sees: row groups
    without any are skipped where a table is sorted by id."""
    return df.where(F.col(column).isin(sorted({i for i in ids if i is not None})))


def _row_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(
        kind.elementType, (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)
    ):
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 24
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 32
    return F.lit(8)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) of `df`: one partial aggregate, two numbers to the driver."""
    size = F.lit(16)
    for field in df.schema.fields:
        size = size + _row_bytes(field)
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return int(row[0]), int(row[1])


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring; beyond the limit Spark shuffles both sides.

    Evaluates `df` once more, so hand it narrow or materialised frames.
    """
    return F.broadcast(df) if measure(df)[1] <= max_bytes else df


def broadcast_ids(ids: DataFrame, max_rows: int | None = None) -> DataFrame:
    """`broadcast_if_small` for frames of a few numbers per row; a proven `max_rows`
    spares the measuring."""
    if max_rows is None or not _fixed_width(ids):
        return broadcast_if_small(ids)
    row = 16 + 8 * len(ids.columns)
    return F.broadcast(ids) if max_rows * row <= BROADCAST_BYTES else ids


def _fixed_width(df: DataFrame) -> bool:
    return all(
        isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))
        for f in df.schema.fields
    )
