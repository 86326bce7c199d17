"""SimHash near-dedup with bit-sliced comparison.

Documents become 64-bit fingerprints, and equal fingerprints become one. To find all pairs
within a radius r exactly, the 64 bits are cut into r + `spare` segments: two fingerprints
within r agree on `spare` segments at least. For each choice of `spare` segments, rows
that agree there form a block, and within blocks all are compared.

The comparison is bit-sliced. The fingerprints of many blocks stand in one sorted array, of
which plane b holds bit b of each, 64 lanes to a word. One step compares every lane with
the lane d places on, for d = 1, 2, ... up to the longest block: planes are XORed with
their shifted selves and added up in carry-save counters, 64 distances to an operation.
Stretches of lanes are abandoned once all of them are beyond the radius.

A block gives a tree of links, not its pairs. Blocks above `tile` rows are cut into tiles,
and each pair of tiles is a block of its own, so that no task gets an unbounded one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import column, free_name, join_apart
from newsloom.llm.components import connected_components
from newsloom.session import materialize

RADIUS = 4
SHINGLE = 4
SPARE = 2
TILE = 16_384
SEED = 42
_LANES = 4096
_ROWS = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as an unsigned 64-bit number: a bit is set if more than half of
    the hashes of the word shingles have it. No words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return F.pandas_udf(run, "long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row b, lane i is bit b of value i."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    lanes[:, : len(values)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Packed lanes in which two sets of planes differ in at most `radius` planes.

    Carry-save: counter j holds bit j of each lane's distance; a lane that passes the
    radius saturates. Ends early when every lane has passed it."""
    width = left.shape[1]
    need = (radius + 1).bit_length()
    counter = np.zeros((need, width), np.uint64)
    full = np.zeros(width, np.uint64)
    for b in range(64):
        carry = left[b] ^ right[b]
        for j in range(need):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        full |= carry
        if b % 8 == 7:
            over = full | _above(counter, radius)
            if (~over == 0).all():
                return np.zeros(width, np.uint64)
    return ~(full | _above(counter, radius))


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is larger than `radius`."""
    more = np.zeros(counter.shape[1], np.uint64)
    same = ~more
    for j in range(len(counter) - 1, -1, -1):
        if radius >> j & 1:
            same = same & counter[j]
        else:
            more |= same & counter[j]
            same = same & ~counter[j]
    return more


def linked_lanes(blocks: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs within the radius in the same block. `blocks` is sorted."""
    edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
    sizes = np.diff(np.concatenate((edges, [len(blocks)])))
    left, right = [], []
    d = 1
    ends = np.repeat(edges + sizes, sizes)
    lanes = np.flatnonzero(np.arange(len(blocks)) + d < ends)
    while len(lanes):
        for i in range(0, len(lanes), _LANES):
            part = lanes[i : i + _LANES]
            near = within(planes_of(values[part]), planes_of(values[part + d]), radius)
            if near.any():
                hit = np.unpackbits(near.view(np.uint8), bitorder="little")[: len(part)]
                hit = part[hit.astype(bool)]
                left.append(hit)
                right.append(hit + d)
        d += 1
        lanes = lanes[lanes + d < ends[lanes]]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _tree(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join what `left` and `right` join, fewer than places."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for i, j in zip(left.tolist(), right.tolist()):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            yield i, j


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_block, held_value = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(blocks, values):
            i, j = linked_lanes(blocks, values.view(np.uint64), radius)
            pairs = np.array(list(_tree(i, j)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(values[pairs[:, 0]]), pa.array(values[pairs[:, 1]])], names=["node", "other"]
            )

        for batch in batches:
            held_block = np.concatenate((held_block, batch.column(0).to_numpy()))
            held_value = np.concatenate((held_value, batch.column(1).to_numpy()))
            if len(held_block) >= _ROWS:
                cut = int(np.searchsorted(held_block, held_block[-1]))
                if cut:
                    yield links(held_block[:cut], held_value[:cut])
                    held_block, held_value = held_block[cut:], held_value[cut:]
        if len(held_block):
            yield links(held_block, held_value)

    return run


def near_links(values: DataFrame, radius: int = RADIUS, spare: int = SPARE, tile: int = TILE) -> DataFrame:
    """Links (node, other) between distinct 64-bit `value`s at most `radius` bits apart.

    Not all pairs, but enough of them to join every two values that a chain of such pairs
    joins. Values must be distinct."""
    segments = radius + spare
    cuts = [64 * i // segments for i in range(segments + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(segments), spare)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col("value").bitwiseAND(F.lit(signed).cast("long"))))
    keyed = values.select("value", F.explode(F.array(*keys)).alias("block"))
    # more rows than a tile: each pair of tiles is a block
    large = keyed.groupBy("block").count().filter(F.col("count") > tile).select(
        F.col("block").alias("large"), F.ceil(F.col("count") / tile).cast("int").alias("tiles")
    )
    own = F.pmod(F.xxhash64("value", F.lit(1)), F.col("tiles")).cast("int")
    dealt = (
        keyed.join(large, F.col("block") == F.col("large"), "left")
        .withColumn("own", own)
        .withColumn("with", F.explode_outer(F.when(F.col("tiles").isNotNull(), F.sequence(F.lit(0), F.col("tiles") - 1))))
        .select(
            F.when(F.col("tiles").isNull(), F.col("block"))
            .otherwise(F.xxhash64("block", F.least("own", "with"), F.greatest("own", "with")))
            .alias("block"),
            "value",
        )
    )
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(n, "block")
        .sortWithinPartitions("block", "value")
        .mapInArrow(_compare(radius), "node long, other long")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    spare: int = SPARE,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    A-Z are lower-cased; fewer words than a shingle are one shingle; null, empty and blank
    texts have the fingerprint 0 and are linked like any other. component_id is the
    smallest id that a chain of links reaches, null if all ids there are null. Repeated rows
    stay. An empty table gives an empty result. Other columns are not looked at.
    """
    marked = materialize(
        docs.select(column(id_col).alias("doc_id"), _fingerprints(shingle, SEED)(column(text_col)).alias("value")),
        "fingerprints",
    )
    return _with_least(marked, F.col("doc_id"), radius, spare, tile).select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), F.col("least_first").alias("component_id")
    )


def _with_least(marked: DataFrame, first: Column, radius: int, spare: int, tile: int) -> DataFrame:
    """`marked` with least_first, the smallest `first` in the component of each row's `value`."""
    values = materialize(marked.groupBy("value").agg(F.min(first).alias("first")), "values")
    links = materialize(near_links(values.select("value"), radius, spare, tile), "links")
    stars = connected_components(links)
    rooted = values.join(stars, F.col("value") == F.col("node"), "left").select(
        "value", "first", F.coalesce("least", "value").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least_first"))
    labels = join_apart(rooted, least, "root").select("value", "least_first")
    return marked.join(labels, "value")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    spare: int = SPARE,
    tile: int = TILE,
) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id, null ids
    last, and of rows with one id that with the smallest hash of the text. Ids may repeat
    and may be null. Rows that repeat id and text count as one."""
    text_key = F.xxhash64(column(text_col))
    marked = materialize(
        docs.select(
            column(id_col).alias("doc_id"),
            text_key.alias("text_key"),
            _fingerprints(shingle, SEED)(column(text_col)).alias("value"),
        ),
        "fingerprints",
    )
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    chosen = F.col("doc_id").eqNullSafe(F.col("least_first.doc_id")) & (F.col("text_key") == F.col("least_first.text_key"))
    found = materialize(
        _with_least(marked, first, radius, spare, tile).select("doc_id", "text_key", chosen.alias("chosen"))
        .groupBy("doc_id", "text_key", "chosen").agg(F.count(F.lit(1)).alias("n_rows")),
        "found",
    )
    id_name, key_name, own_key = (free_name(docs, n) for n in ("found_id", "found_key", "text_key"))
    found = found.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name), "chosen", "n_rows")
    same = column(id_col).eqNullSafe(F.col(id_name)) & (text_key == F.col(key_name))
    keys = [id_name, key_name]
    again = found.filter("chosen and n_rows > 1").select(keys)
    if again.isEmpty():  # no row repeats, as it should be: texts are joined once
        return docs.join(found.filter("not chosen").select(keys), same, "left_anti")
    repeated = docs.join(again, same, "left_semi").withColumn(own_key, text_key)
    return docs.join(found.filter("not chosen or n_rows > 1").select(keys), same, "left_anti").unionByName(
        repeated.dropDuplicates([id_col, own_key]).drop(own_key)
    )
