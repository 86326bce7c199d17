"""Running totals over the rows of a key, without gathering a key in one task.

Rows are cut by range of key and order, so that a key with very many rows lies in several
partitions. Each partition's total of a key is added up first; what the partitions before
hold of it is a table with one row a partition at most, and the rest happens inside them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import materialize


class Total(NamedTuple):
    """A running total: how values are added up, how two totals join, and of what."""

    gather: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    of: Column


def summed(of: Column) -> Total:
    return Total(F.sum, lambda a, b: a + b, of)


def mixed(of: Column) -> Total:
    """Exclusive or, for hashes."""
    return Total(F.bit_xor, lambda a, b: a.bitwiseXOR(b), of)


def before_each(rows: DataFrame, key: str, order: Sequence[Column], totals: dict[str, Total]) -> DataFrame:
    """`rows` with each of `totals` over the rows of the same key that stand earlier.

    Rows that are equal in key and order are interchangeable: the caller sees to it that
    this does not show. Values are longs without nulls, the total of no row is 0.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_of_{name}" for name in totals]
    valued = rows.select("*", *[t.of.cast("long").alias(v) for v, t in zip(names, totals.values())])
    cut = materialize(
        valued.repartitionByRange(n, F.col(key), *order).withColumn("_part", F.spark_partition_id()), "cut"
    )
    by_part = cut.groupBy(key, "_part").agg(*[t.gather(F.col(v)).alias(v) for v, t in zip(names, totals.values())])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        by_part.select(
            F.col(key).alias("_key"),
            F.col("_part").alias("_in"),
            F.lag("_part").over(Window.partitionBy(key).orderBy("_part")).isNotNull().alias("_later"),
            *[t.gather(F.col(v)).over(earlier).alias(f"{v}_carried") for v, t in zip(names, totals.values())],
        )
        # of the keys in a partition only the first can have begun before: one row a partition
        .where("_later")
        .drop("_later")
    )
    within = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.coalesce(t.gather(F.col(v)).over(within), F.lit(0)).alias(f"{v}_local") for v, t in zip(names, totals.values())],
    )
    same = (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_in"))
    both = local.join(F.broadcast(carried), same, "left")
    return both.select(
        *rows.columns,
        *[
            t.join(F.col(f"{v}_local"), F.coalesce(f"{v}_carried", F.lit(0))).alias(name)
            for (name, t), v in zip(totals.items(), names)
        ],
    )
