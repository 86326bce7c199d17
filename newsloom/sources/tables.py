"""Reading stored tables. A target is a catalog table name or a Parquet path."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.sizes import broadcast_ids


def is_path(target: str) -> bool:
    return "/" in target


def read_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if is_path(target) else spark.table(target)


def read_if_present(spark: SparkSession, target: str) -> DataFrame | None:
    """`read_table`, or None if there is no such table or nothing at the path yet."""
    if not is_path(target) and not spark.catalog.tableExists(target):
        return None
    try:
        return read_table(spark, target)
    except AnalysisException as error:
        if is_path(target) and error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def partition_columns(spark: SparkSession, target: str) -> list[str]:
    """Columns that a table is partitioned by; of a path, those that its folders hold and
    its files do not."""
    if not is_path(target):
        return [c.name for c in spark.catalog.listColumns(target) if c.isPartition]
    inside = spark.read.option("recursiveFileLookup", True).parquet(target).columns
    return [c for c in spark.read.parquet(target).columns if c not in inside]


def read_query(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Rows of a SQL query; `{name}` in the text refers to a frame passed as `name=`."""
    return spark.sql(query, **frames)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """Rows of a query run by an external database, in parallel ranges of
    `partition_column` when one is given."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    if None in (lower, upper, partitions):
        raise ValueError("a partitioned read needs lower, upper and partitions")
    return (
        reader.option("dbtable", f"({query}) AS source")
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def full_articles(
    raw: DataFrame, ids: DataFrame, id_col: str = "news_id", max_ids: int | None = None
) -> DataFrame:
    """`id, content` of the articles whose id occurs in `ids`; no ids, no rows.

    The ids are made distinct before anything is joined. A small set is broadcast, so
    that article text is scanned once and never shuffled. `max_ids` is a bound the
    caller can prove; without it the set is measured.
    """
    wanted = ids.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    return raw.select("id", "content").join(broadcast_ids(wanted, max_ids), "id", "left_semi")
