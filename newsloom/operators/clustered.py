"""Metadata stored along a curve, and searched page by page.

A search names a category, a publisher, a range of dates, or several of them. Rows are stored
in Z order of the three, so that those of one value of any of them lie in few row groups, and
the least and greatest values of a row group tell the reader that it can be skipped. Each of
the three is cut into as many ranges of about equal weight, found on a bounded sample.

A page continues after the last key of the page before, so that it costs the same wherever it
lies, and rows that come in meanwhile shift nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.sizes import LITERAL_IDS, with_ids
from newsloom.operators.search import metadata_filter

DIMENSIONS = ("published_at", "category", "publisher")
#: Bits of a dimension in the curve.
BITS = 6
#: Rows that the ranges are found on: those with the least hash of their id.
SAMPLE_ROWS = 20_000
#: Bytes of a row group.
ROW_GROUP_BYTES = 8 << 20


def _cuts(values: Sequence[Any], bits: int) -> list[Any]:
    """At most 2**bits - 1 values that cut the others into parts of about equal weight."""
    values = sorted(v for v in values if v is not None)
    parts = 1 << bits
    places = {values[len(values) * i // parts] for i in range(1, parts)} if values else set()
    return sorted(places)


def _range_of(value: Column, cuts: list[Any], low: int = 0) -> Column:
    """Number of cuts that are not above a value, by halving; null lies first."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    above = _range_of(value, cuts[middle + 1 :], low + middle + 1)
    return F.when(value >= F.lit(cuts[middle]), above).otherwise(_range_of(value, cuts[:middle], low))


def curve(dimensions: Sequence[Column], bits: int = BITS) -> Column:
    """Bits of whole numbers below 2**bits, one of each in turn, the highest first."""
    total = F.lit(0).cast("long")
    for bit in range(bits):
        for i, number in enumerate(dimensions):
            one = F.shiftright(number.cast("long"), bit).bitwiseAND(F.lit(1))
            total = total.bitwiseOR(F.shiftleft(one, bit * len(dimensions) + len(dimensions) - 1 - i))
    return total


def write_clustered(
    metadata: DataFrame,
    folder: str,
    dimensions: Sequence[str] = DIMENSIONS,
    key: str = "id",
    bits: int = BITS,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write metadata along the curve through `dimensions`. Null counts as the least value."""
    sample = metadata.select(*dimensions).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).collect()
    types = {f.name: f.dataType for f in metadata.schema.fields}
    numbers = []
    for name in dimensions:
        cuts = _cuts([row[name] for row in sample], bits)
        if cuts and isinstance(cuts[0], dt.datetime):
            cuts = [c.isoformat(" ") for c in cuts]
            value = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            value = F.col(name).cast(types[name])
        numbers.append(_range_of(value, cuts))
    n = int(metadata.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_curve", *dimensions, key]
    (
        metadata.withColumn("_curve", curve(numbers, bits))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .drop("_curve")
        .write.option("parquet.block.size", row_group_bytes)
        .parquet(folder)
    )


class Page(NamedTuple):
    rows: DataFrame  # title, publisher, link, newest first
    after: tuple[dt.datetime | None, int] | None  # hand it to the next call; None behind the last page


def metadata_page(
    metadata: DataFrame,
    raw: DataFrame,
    size: int,
    after: tuple[dt.datetime | None, int] | None = None,
    category: str | None = None,
    publisher: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> Page:
    """The next `size` rows of `search.metadata_search`, newest first, undated ones before them,
    ties by id. Rows without an id are on no page.

    Each task passes on a page at most, and links are looked up for the rows of the page.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    found = metadata_filter(metadata, category, publisher, start, end).where("id IS NOT NULL")
    at, key = F.col("published_at"), F.col("id")
    if after is not None:
        moment, last = after
        if moment is None:
            found = found.where(at.isNotNull() | (key > last))
        else:
            bound = F.lit(moment.isoformat(" ")).cast("timestamp_ntz")
            # the first condition is implied, and reaches the reader
            found = found.where((at <= bound) & ((at < bound) | (key > last)))
    rows = (
        found.select("published_at", "id", "news_id", "title", "publisher")
        .orderBy(F.desc_nulls_first("published_at"), "id")
        .limit(size)
        .collect()
    )
    spark = metadata.sparkSession
    schema = "published_at timestamp_ntz, id bigint, news_id bigint, title string, publisher string"
    page = spark.createDataFrame(rows, schema)
    links = raw.select(F.col("id").alias("_article"), "link")
    if size <= LITERAL_IDS:
        links = with_ids(links, "_article", [r["news_id"] for r in rows])
    joined = F.broadcast(page).join(links, F.col("news_id") == F.col("_article"), "left")
    ordered = joined.orderBy(F.desc_nulls_first("published_at"), "id").select("title", "publisher", "link")
    more = len(rows) == size
    return Page(ordered, (rows[-1]["published_at"], rows[-1]["id"]) if more else None)
