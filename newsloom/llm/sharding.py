"""Sharding by fixed virtual slots.

A text's hash names one of some thousand slots for good, so that equal texts stay together. Bytes are added up per slot, and
a versioned map says which shard holds which slot. Rebalancing edits the map: it moves as
few slots as it can, and no record is hashed anew. The map and the bytes per slot have as
many rows as there are slots, so that they may be planned on the driver and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import column
from newsloom.session import materialize

SLOTS = 4096
SHARDS = 8
#: Every slot is cut into 2 to this power bins, in which records are numbered.
_BIN_BITS = 4

MAP_SCHEMA = "version int, slot int, shard int, bytes long"


def record_hash(text: Column) -> Column:
    """Hash of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slot_of(hashed: Column, slots: int = SLOTS) -> Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def first_map(sizes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> list[tuple]:
    """Version 1: slots in order of falling bytes, each to the shard with the fewest so far."""
    load, rows = [0] * shards, []
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        shard = min(range(shards), key=lambda k: (load[k], k))
        load[shard] += sizes.get(slot, 0)
        rows.append((1, slot, shard, sizes.get(slot, 0)))
    return sorted(rows)


def edited_map(old: Iterable[tuple], sizes: dict[int, int], shards: int) -> list[tuple]:
    """The next version, for new bytes per slot or another number of shards.

    Slots of shards that are gone, and slots that no longer fit below the mean of a shard,
    move to the shard with the fewest bytes; all others stay where they are.
    """
    old = list(old)
    total = sum(sizes.get(slot, 0) for _, slot, _, _ in old)
    mean, load, moving, rows = total / shards, [0] * shards, [], []
    for version, slot, shard, _ in sorted(old, key=lambda r: (sizes.get(r[1], 0), r[1])):
        size = sizes.get(slot, 0)
        if shard < shards and load[shard] + size <= mean:
            load[shard] += size
            rows.append((version + 1, slot, shard, size))
        else:
            moving.append((version + 1, slot, size))
    for version, slot, size in sorted(moving, key=lambda r: (-r[2], r[1])):
        shard = min(range(shards), key=lambda k: (load[k], k))
        load[shard] += size
        rows.append((version, slot, shard, size))
    return sorted(rows)


def write_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Add a version to the stored map; readers take the one they name, or the latest."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes per slot of a frame with `slot` and `bytes`; at most one row per slot is collected."""
    return {r[0]: int(r[1]) for r in rows.groupBy("slot").agg(F.sum("bytes")).collect()}


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, map_version.

    Size is the text's UTF-8 bytes plus 1 (null: 1). The law is `bytes`: sizes of shards are
    near equal. Equal texts, null and empty among them, lie in one shard; a group of them that
    is larger than a shard's share is all that can make sizes uneven. `slot` is the record's
    place in its shard, gapless from 0, in the order of virtual slot, bin, hash and id. With
    `map_path` the map stored there is edited if it exists, and the version used is added to
    it. Repeated rows have places of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_, text = column(id_col), column(text_col)
    hashed = docs.select(
        id_.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        slot_of(record_hash(text), slots).alias("virtual_slot"),
        # the rows of one text are spread over the bins of its slot
        F.xxhash64(id_, text).alias("hash"),
    ).withColumn("bin", F.shiftrightunsigned("hash", 64 - _BIN_BITS).cast("int"))
    hashed = materialize(hashed, "hashed")
    bins = materialize(
        hashed.groupBy(F.col("virtual_slot").alias("slot"), "bin").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
        ),
        "slots",
    )
    sizes = slot_sizes(bins)
    if map_path and _exists(spark, map_path):
        rows = edited_map([tuple(r) for r in read_map(spark, map_path).collect()], sizes, shards)
    else:
        rows = first_map(sizes, shards, slots)
    if map_path:
        write_map(spark, rows, map_path)
    where = spark.createDataFrame(rows, MAP_SCHEMA).select("version", "slot", "shard")
    order = Window.partitionBy("shard").orderBy("slot", "bin").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2**_BIN_BITS rows for each slot
    places = (
        bins.join(F.broadcast(where), "slot")
        .withColumn("earlier", F.coalesce(F.sum("rows").over(order), F.lit(0)))
        .select(F.col("slot").alias("virtual_slot"), "bin", "shard", "earlier", F.col("version").alias("map_version"))
    )
    within = Window.partitionBy("virtual_slot", "bin").orderBy("hash", "doc_id", "text_crc32", "size")
    return hashed.join(F.broadcast(places), ["virtual_slot", "bin"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("earlier") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
