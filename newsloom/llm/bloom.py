"""Bloom filters as tables: 64-bit words with their number, two bits a key in one word.

A filter has `BITS_PER_KEY` bits a key up to `MAX_BITS`, so that its table may be broadcast
whatever the input: 2 million words of 16 bytes, some 64 MB in memory. A fuller filter lets
more rows through and loses none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BITS = 1 << 27

_WORD, _FIRST, _SECOND, _MASK = "bloom_word", "bloom_first", "bloom_second", "bloom_mask"


def bits_for(keys: int, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> int:
    bits = 1 << 12
    while bits < min(keys * bits_per_key, max_bits):
        bits *= 2
    return bits


def _placed(df: DataFrame, key: str, bits: int) -> DataFrame:
    place = F.xxhash64(key)
    return df.withColumns(
        {
            _WORD: place.bitwiseAND(F.lit(bits // 64 - 1)),
            _FIRST: F.shiftrightunsigned(place, 52).bitwiseAND(F.lit(63)).cast("int"),
            _SECOND: F.shiftrightunsigned(place, 58).bitwiseAND(F.lit(63)).cast("int"),
        }
    )


def filter_of(df: DataFrame, key: str, bits: int, at_least: int = 1) -> DataFrame:
    """The filter's words, with the bits that `at_least` rows of `df` set. Bit positions and
    counts shuffle, added up per task first."""
    return (
        _placed(df.select(key), key, bits)
        .select(_WORD, F.explode(F.array(_FIRST, _SECOND)).alias("bit"))
        .groupBy(_WORD, "bit")
        .count()
        .filter(F.col("count") >= at_least)
        .groupBy(_WORD)
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias(_MASK))
    )


def tested(df: DataFrame, key: str, words: DataFrame, bits: int, result: str) -> DataFrame:
    """`df` with the column `result`: false only if the key is surely not in the filter."""
    own = F.expr(f"shiftleft(1L, {_FIRST}) | shiftleft(1L, {_SECOND})")
    return (
        _placed(df, key, bits)
        .join(F.broadcast(words), _WORD, "left")
        .withColumn(result, F.coalesce(F.col(_MASK).bitwiseAND(own) == own, F.lit(False)))
        .drop(_WORD, _FIRST, _SECOND, _MASK)
    )
