"""Row selection behind the keyed writes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.functions.sizes import BROADCAST_BYTES, LITERAL_IDS, measure


# Types of keys that may be written into a plan as literals.
_PLAIN = (T.StringType, T.IntegralType, T.DateType)

# Values in one list that Spark hands to the Parquet reader as values, not as a range.
_IN_LIST = 10


def any_of(column: Column, values: Iterable) -> Column:
    """Whether a column has one of a few values, null among them, as a filter for which the Parquet
    reader consults the Bloom filters of a file where it has some."""
    values = list(values)
    plain = [v for v in values if v is not None]
    lists = [column.isin(plain[i : i + _IN_LIST]) for i in range(0, len(plain), _IN_LIST)]
    if None in values:
        lists.append(column.isNull())
    return reduce(Column.__or__, lists) if lists else F.lit(False)


def unseen(
    new: DataFrame,
    stored: DataFrame,
    key: str,
    null_safe: bool = True,
    max_bytes: int = BROADCAST_BYTES,
    max_literals: int = LITERAL_IDS,
) -> DataFrame:
    """Rows of `new` whose key does not occur in `stored`; duplicates within `new` stay.

    The batch's distinct keys are measured. A few are looked up as literals, for which the
    reader skips what cannot hold them. While they fit, they are broadcast against one scan
    of the stored key column, which leaves at most those keys to exclude. A large batch is
    anti-joined by shuffle, against distinct keys so that a frequent stored key travels once;
    of a table that is bucketed by the key only the batch is shuffled.
    `new` is evaluated for each of these, so hand it a stored copy where that is costly.
    """

    def same(left: Column, right: Column) -> Column:
        return left.eqNullSafe(right) if null_safe else left == right

    keys = new.select(F.col(key).alias("_incoming")).distinct()
    old = stored.select(F.col(key).alias("_stored"))
    count, size = measure(keys)
    alike = new.schema[key].dataType == stored.schema[key].dataType and isinstance(new.schema[key].dataType, _PLAIN)
    if count <= max_literals and size <= max_bytes and alike:
        wanted = [r[0] for r in keys.collect() if null_safe or r[0] is not None]
        found = old.where(any_of(F.col("_stored"), wanted)).distinct()
        known = [r[0] for r in found.collect()] if wanted else []
        return new.where(~F.coalesce(any_of(F.col(key), known), F.lit(False)))
    if size <= max_bytes:
        old = old.join(
            F.broadcast(keys), same(F.col("_stored"), F.col("_incoming")), "left_semi"
        ).distinct()
        return new.join(F.broadcast(old), same(F.col(key), F.col("_stored")), "left_anti")
    # plain equality, which a table bucketed by the key needs no shuffle for; nulls apart
    if null_safe and not old.where("_stored IS NULL").isEmpty():
        new = new.where(F.col(key).isNotNull())
    old = old.where("_stored IS NOT NULL").distinct()
    return new.join(old, F.col(key) == F.col("_stored"), "left_anti")


def first_per_key(
    df: DataFrame, key: str, *order: str | Column, nulls_distinct: bool = False
) -> DataFrame:
    """The first row of every key by `order`, which should be total.

    Spark limits each task to one row per key before the shuffle, so a frequent key
    does not gather in one place. `nulls_distinct` keeps every row with a null key.
    """
    if not order:
        raise ValueError("first_per_key needs an order")
    groups = [F.col(key)]
    if nulls_distinct:
        groups.append(F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
        df = df.select("*", *[g.alias(f"_group{i}") for i, g in enumerate(groups)])
        groups = [F.col(f"_group{i}") for i in range(len(groups))]
    window = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .where("_place = 1")
        .drop("_place", "_group0", "_group1")
    )


def update_by_key(
    table: DataFrame,
    updates: DataFrame,
    key: str,
    columns: Sequence[str],
    *order: str | Column,
    flag: str | None = None,
) -> DataFrame:
    """`table` with `columns` of matching rows replaced; no row is added or dropped.

    Of several updates to one key the last by `order` wins. A null value is written.
    `flag` names an extra column telling which rows matched.
    """
    if not order:
        raise ValueError("update_by_key needs the order of the updates")
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    last = (
        updates.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max_by(F.struct(*columns), place).alias("_new"))
    )
    joined = table.join(last, F.col(key) == F.col("_key"), "left")
    matched = F.col("_key").isNotNull()
    result = [
        F.when(matched, F.col(f"_new.`{f.name}`").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in columns
        else F.col(f.name)
        for f in table.schema.fields
    ]
    if flag is not None:
        result.append(matched.alias(flag))
    return joined.select(*result)
