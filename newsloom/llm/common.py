"""Words and small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or a longer form of it that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_apart(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with what an aggregation by `key` gave. The key's hash as a second key
    keeps the join in a stage behind the aggregation, where adaptive execution can split a
    key that very many rows of `left` share."""
    apart = free_name(left, "key_hash")
    hashed = F.xxhash64(column(key))
    return left.withColumn(apart, hashed).join(right.withColumn(apart, hashed), [key, apart]).drop(apart)
