"""Prefix trie of conversations by ROLLUP over positional columns.

Every turn has an id, a 128-bit hash of role and text. A conversation is a row with the ids
of its first eight turns in eight columns, and one ROLLUP over these columns aggregates all
its prefixes at once; grouping_id tells how long each is. Turns from the ninth on stand in
further rows of eight columns, keyed by the node at which the row before ended. A node's key
is the exclusive or of hashes of (position, turn id) along its path, so that it follows from
running totals and needs no pass per block.

Equal conversations are one row with a weight. Each node belongs to its smallest member,
which brings it up once: sums over a subtree are sums over the members of what they own
further down, and a second ROLLUP over the same rows adds these up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import running
from newsloom.llm.common import column
from newsloom.session import materialize

#: Positional columns of a row.
WIDTH = 8
#: Turns that a rebuilt conversation may share with its base: fewer than this.
SHARED = 9
FAMILY = 5

_NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, pos (from 0), a, b (the turn's id) and size (bytes of the text).

    By turn, nulls first; turns of one number stand in the order of their ids. Rows
    without a conversation are left out.
    """
    role, text = F.coalesce(column(role_col), F.lit("")), F.coalesce(column(text_col), F.lit(""))
    turns = rows.where(column(id_col).isNotNull()).select(
        column(id_col).cast("long").alias("conv_id"),
        column(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    placed = running.before_each(turns, "conv_id", order, {"pos": running.summed(F.lit(1))})
    return placed.select("conv_id", "pos", "a", "b", "size")


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """The turns of every conversation c rebuilt: the first h of conversation c - c % family,
    then its own after its first h; h is the checksum of the decimal c, modulo `shared`.

    Each conversation also has a row at position 0 without a turn, so that one without
    turns stays.
    """
    lengths = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "lengths")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(shared))
    base = F.col("conv_id") - F.col("conv_id") % family
    known = lengths.select("conv_id", h.alias("h"), base.alias("base"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    moved = known.join(bases, "base", "left").select(
        "conv_id", "h", (F.least("h", F.coalesce("base_n", F.lit(0))) - F.col("h")).alias("shift")
    )
    own = turns.join(materialize(moved, "moved"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "a", "b", "size")
    heads = turns.where((F.col("pos") < shared) & (F.col("conv_id") % family == 0))
    shared_turns = heads.withColumnRenamed("conv_id", "base").join(known, "base").where("pos < h")
    marks = lengths.select("conv_id", *[F.lit(v).cast("long").alias(c) for c, v in (("pos", 0), ("a", None), ("b", None), ("size", None))])
    return own.unionByName(shared_turns.select("conv_id", "pos", "a", "b", "size")).unionByName(marks)


def _path_hash(salt: int, position: Column, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(salt), position, a, b)


def _slots(of: str) -> list[str]:
    return [f"{of}{i}" for i in range(1, WIDTH + 1)]


def _upto(level: Column, salt: int, below: bool = False) -> Column:
    """Exclusive or of the path hashes of the columns up to `level`, or up to the one before."""
    total = F.lit(0).cast("long")
    for i in range(1, WIDTH + 1):
        turn = F.col(f"t{i}")
        used = (level > i) if below else (level >= i)
        position = F.col("block") * WIDTH + i
        mark = F.when(used & turn.isNotNull(), _path_hash(salt, position, turn["a"], turn["b"]))
        total = total.bitwiseXOR(F.coalesce(mark, F.lit(0)))
    return total


def positional_blocks(turns: DataFrame) -> DataFrame:
    """One row for every eight turns of a conversation: conv_id, block, the turns t1 to t8
    (null beyond the end), and k1, k2: the key of the node at which the row before ended."""
    slot, block = F.col("pos") % WIDTH + 1, F.floor(F.col("pos") / WIDTH).cast("long")
    at = {f"{of}{i}": F.max(F.when(slot == i, F.col(of))) for of in ("a", "b", "size") for i in range(1, WIDTH + 1)}
    rows = turns.groupBy("conv_id", block.alias("block")).agg(*[v.alias(k) for k, v in at.items()])
    rows = rows.select(
        "conv_id",
        "block",
        *[
            F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"size{i}").alias("size"))).alias(f"t{i}")
            for i in range(1, WIDTH + 1)
        ],
    )
    whole = F.lit(WIDTH)
    rows = rows.select("*", _upto(whole, 1).alias("own1"), _upto(whole, 2).alias("own2"))
    totals = {"k1": running.mixed(F.col("own1")), "k2": running.mixed(F.col("own2"))}
    return running.before_each(rows, "conv_id", [F.col("block")], totals)


def _rollup(blocks: DataFrame, *aggregates: str) -> DataFrame:
    """All prefixes of the rows: block, k1, k2, t1 to t8, level and the aggregates. Level 0
    is the root, and is left out in further blocks, whose nodes of level 0 stand before."""
    turns = ", ".join(_slots("t"))
    found = blocks.sparkSession.sql(
        f"""SELECT block, k1, k2, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, {', '.join(aggregates)}
            FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP ({turns})""",
        blocks=blocks,
    )
    last = F.array(*_slots("t"))[F.greatest(F.col("level") - 1, F.lit(0)).cast("int")]
    real = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull())
    return found.withColumn("last", last).where(real)


def _key() -> list[Column]:
    """Depth and key of a node that `_rollup` gave."""
    return [
        (F.col("block") * WIDTH + F.col("level")).alias("depth"),
        F.col("k1").bitwiseXOR(_upto(F.col("level"), 1)).alias("n1"),
        F.col("k2").bitwiseXOR(_upto(F.col("level"), 2)).alias("n2"),
    ]


def _hashed_lists(ends: DataFrame) -> DataFrame:
    """depth, n1, n2, ends_sha256 of (depth, n1, n2, conv_id): the hash of each key's ids.

    A sorted range gives one text for each key in it; the few texts of a key then run
    through one hash in their order, and are never put together.
    """
    key = ["depth", "n1", "n2"]
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out, start = [], 0
            keys = list(zip(*columns[:3]))
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    out.append((*keys[start], columns[3][start], ",".join(map(str, columns[3][start:i]))))
                    start = i
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.large_string()])],
                    [*key, "first", "ids"],
                )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*[c.to_pylist() for c in batch.select([*key, "ids"]).columns]):
                if now != open_key:
                    if open_key:
                        done.append((*open_key, state.hexdigest()))
                    open_key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _hashes(done)
        if open_key:
            yield _hashes([(*open_key, state.hexdigest())])

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*key, "ends_sha256"])

    sorted_ends = ends.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    texts = sorted_ends.select(*key, "conv_id").mapInArrow(runs, "depth long, n1 long, n2 long, first long, ids string")
    texts = texts.repartition(n, *key).sortWithinPartitions(*key, "first")
    return texts.mapInArrow(hashed, "depth long, n1 long, n2 long, ends_sha256 string")


def prefix_trie(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int = FAMILY,
    shared: int = SHARED,
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt first, see `rebuilt_turns`. Null role or text is empty; an
    empty text is a turn like any other. Repeated rows are turns of their own; turns of one
    number stand in the order of their hash. Rows with a null id belong to no conversation
    and are left out. An empty table gives an empty result; other columns are not looked at.
    """
    turns = materialize(ordered_turns(rows, id_col, turn_col, role_col, text_col), "turns")
    blocks = materialize(positional_blocks(rebuilt_turns(turns, family, shared)), "blocks")

    # equal conversations are one row with a weight
    here = F.size(F.array_compact(F.array(*_slots("t")))).cast("long")
    whole = F.lit(WIDTH)
    ends = blocks.groupBy("conv_id").agg(
        F.sum(here).alias("depth"),
        F.bit_xor(_upto(whole, 1)).alias("n1"),
        F.bit_xor(_upto(whole, 2)).alias("n2"),
    )
    ends = materialize(ends, "ends")
    distinct = materialize(
        ends.groupBy("depth", "n1", "n2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")),
        "distinct",
    ).select("conv_id", "weight")
    blocks = materialize(blocks.join(distinct, "conv_id"), "distinct-blocks")

    found = _rollup(blocks, "min(conv_id) AS conv_id", "sum(weight) AS n_convs")
    level = F.col("level")
    nodes = materialize(
        found.select(
            *_key(),
            "block",
            "level",
            "conv_id",
            "n_convs",
            # a node of level 1 hangs from the one before its block
            F.col("k1").bitwiseXOR(_upto(level, 1, below=True)).alias("p1"),
            F.col("k2").bitwiseXOR(_upto(level, 2, below=True)).alias("p2"),
            ((F.col("n_convs") - 1) * F.coalesce(F.col("last.size"), F.lit(0))).alias("saved"),
        ),
        "nodes",
    )
    key = ["depth", "n1", "n2"]
    children = (
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    nodes = materialize(
        nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted"
    )

    # what a conversation owns, at the places of its rows, and further down
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    owned = nodes.where("depth > 0").groupBy("conv_id", "block").agg(
        *[F.sum(F.when(level == i, F.col("saved")).otherwise(0)).alias(f"s{i}") for i in range(1, WIDTH + 1)],
        *[F.sum(F.when(level == i, leaf).otherwise(0)).alias(f"l{i}") for i in range(1, WIDTH + 1)],
    )

    def from_here(of: str, i: int) -> Column:
        return sum((F.col(f"{of}{k}") for k in range(i, WIDTH + 1)), F.lit(0))

    later = running.before_each(
        owned,
        "conv_id",
        [F.col("block").desc()],
        {"s_later": running.summed(from_here("s", 1)), "l_later": running.summed(from_here("l", 1))},
    )
    below = later.select(
        "conv_id",
        "block",
        *[(F.col(f"{of}_later") + from_here(of, i)).alias(f"{of}{i}") for of in ("s", "l") for i in range(1, WIDTH + 1)],
    )
    # rows above the first that a conversation owns pass on all of it
    first = F.min_by(F.struct("s1", "l1"), "block")
    above = below.groupBy("conv_id").agg(first.alias("all"), F.min("block").alias("from"))
    bringing = (
        blocks.join(above, "conv_id")
        .join(below, ["conv_id", "block"], "left")
        .select(
            "block",
            "k1",
            "k2",
            *_slots("t"),
            *[
                F.coalesce(f"{of}{i}", F.when(F.col("block") < F.col("from"), F.col(f"all.{of}1")), F.lit(0)).alias(f"{of}{i}")
                for of in ("s", "l")
                for i in range(1, WIDTH + 1)
            ],
        )
    )
    sums = _rollup(bringing, *[f"sum({c}) AS {c}" for of in ("s", "l") for c in _slots(of)])
    at = F.greatest(level, F.lit(1)).cast("int")
    subtrees = sums.select(
        *_key(),
        F.array(*_slots("s"))[at - 1].alias("saved_tokens"),
        F.array(*_slots("l"))[at - 1].alias("n_leaves"),
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("n1").alias("p1"),
        F.col("n2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        nodes.join(parents, ["depth", "p1", "p2"], "left")
        .join(subtrees, key, "left")
        .join(_hashed_lists(ends), key, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            F.col("n_convs").cast("long"),
            F.col("n_children").cast("long"),
            F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )
