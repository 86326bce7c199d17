"""Exact dedup by a two-pass Bloom filter.

Pass one sets two bits per row in a filter of 64-bit words and keeps the bits that more
than one row has set. What it shuffles is a bit position and a count. Pass two tests every
row against that filter, which is broadcast: its size has a bound, whatever the input.
Rows that fail the test are alone in their group and pass straight through. The rest, all
true copies and a few chance hits, are grouped by SHA-256. Documents never move, and
neither do their texts.

The filter has `bits_per_row` bits a row up to `max_bits`. Beyond that it fills up, more
rows take the second way, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import bloom
from newsloom.llm.common import column, free_name, join_apart
from newsloom.session import materialize


def _tested(
    docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, max_bits: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with a number and the test's verdict; and the groups of rows that may have copies:
    text_sha256, keep_id, keep_row, group_size."""
    signed = materialize(
        docs.select(
            column(id_col).alias("doc_id"),
            F.sha2(F.coalesce(column(text_col), F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "signatures",
    )
    bits = bloom.bits_for(signed.count(), bits_per_row, max_bits)
    words = materialize(bloom.filter_of(signed, "text_sha256", bits, at_least=2), "bloom")
    tested = bloom.tested(signed, "text_sha256", words, bits, "maybe")
    # null ids lose to any other
    groups = tested.filter("maybe").groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"),
        F.min("row").alias("any_row"),
        F.max_by("row", "doc_id").alias("best_row"),
        F.count(F.lit(1)).alias("group_size"),
    )
    return tested, groups.withColumn("keep_row", F.coalesce("best_row", "any_row")).drop("best_row", "any_row")


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = bloom.BITS_PER_KEY,
    max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; of rows that repeat both id and text
    one stays. Null text equals the empty text. A null id stays only in a group without any
    other. An empty table gives an empty result. Other columns are not looked at.
    """
    tested, groups = _tested(docs, id_col, text_col, bits_per_row, max_bits)
    alone = tested.filter(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    grouped = join_apart(tested.filter("maybe"), groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, one row of each text."""
    id_name, sha_name = free_name(docs, "marked_id"), free_name(docs, "marked_sha256")
    marked = mark_copies(docs, id_col, text_col)
    # ids and hashes of which some rows go: all of them, or all but one
    pairs = (
        marked.filter("group_size > 1")
        .groupBy(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha_name))
        .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n_rows"))
        .filter("not stays or n_rows > 1")
    )
    pairs = materialize(pairs, "pairs")
    text = F.coalesce(column(text_col), F.lit(""))

    def same(rows: DataFrame):
        return column(id_col).eqNullSafe(rows[id_name]) & (F.sha2(text, 256) == rows[sha_name])

    again = pairs.filter("stays")
    once = docs.join(pairs, same(pairs), "left_anti")
    signed = docs.join(again, same(again), "left_semi").withColumn(sha_name, F.sha2(text, 256))
    return once.unionByName(signed.dropDuplicates([id_col, sha_name]).drop(sha_name))
