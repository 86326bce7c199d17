"""Writing tables. A target is a catalog table name or a Parquet path.

Each call is one Spark write, committed as a whole; one writer per table at a time.
The rows written are counted while they are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.sizes import broadcast_if_small
from newsloom.operators.upsert import any_of, first_per_key, unseen, update_by_key
from newsloom.session import discard, materialize
from newsloom.sources.tables import is_path, partition_columns, read_if_present, read_table

_MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def _bloom(key: str | None) -> dict[str, str]:
    """Writer option that gives files a Bloom filter of the key, by which a later lookup of a few
    keys skips most of them."""
    return {} if key is None else {f"parquet.bloom.filter.enabled#{key}": "true"}


def _by_bucket(df: DataFrame, table: str) -> DataFrame:
    """Rows for a bucketed table with those of a bucket together, so that a write adds few files;
    a bucket of very many rows may be split. Rows for other tables stay as they are."""
    spark = df.sparkSession
    keys = [c.name for c in spark.catalog.listColumns(table) if c.isBucket]
    if not keys:
        return df
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    bucket = F.pmod(F.hash(*keys), F.lit(int(facts["Num Buckets"])))
    return df.withColumn("_bucket", bucket).hint("rebalance", "_bucket").drop("_bucket")


def _write(
    df: DataFrame, target: str, mode: str = "append", partitions: Sequence[str] = (), key: str | None = None
) -> int:
    """One write that keeps the target's partitioning, so that what it adds is read back."""
    seen = Observation()
    into = mode == "append" and not is_path(target) and df.sparkSession.catalog.tableExists(target)
    if into:
        df = _by_bucket(df, target)
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).options(**_bloom(key))
    if is_path(target):
        writer.partitionBy(*partitions).parquet(target)
    elif into:
        writer.insertInto(target)  # by position, which _conform has put right
    else:
        writer.format("parquet").partitionBy(*partitions).saveAsTable(target)
    return int(seen.get["rows"])


# monotonically_increasing_id: the task above these bits, the row's place below
_PLACE_BITS = 33


def _numbered(df: DataFrame, stored: DataFrame | None, id_col: str) -> DataFrame:
    """`df` with ids that follow the largest stored one without a gap.

    `df` must give the same rows in the same tasks twice, such as a stored copy: rows are
    counted per task first, and each task then numbers its own.
    """
    top = 0
    if stored is not None:
        top = stored.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    spark, place = df.sparkSession, F.monotonically_increasing_id()
    task = F.shiftrightunsigned(place, _PLACE_BITS)
    counts = df.select(task.alias("task")).groupBy("task").count().orderBy("task").collect()
    before, offsets = top, []
    for row in counts:
        offsets.append((row["task"], before))
        before += row["count"]
    first = F.broadcast(spark.createDataFrame(offsets, "_task bigint, _first bigint"))
    placed = df.select("*", place.alias("_place")).withColumn(
        "_task", F.shiftrightunsigned("_place", _PLACE_BITS)
    )
    return placed.join(first, "_task").select(
        (F.col("_first") + F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1) + 1).alias(id_col), *df.columns
    )


def _conform(df: DataFrame, stored: DataFrame | None, strict: bool = True) -> DataFrame:
    """The stored columns in order. A stored column the rows lack is null; one the table
    lacks is an error if `strict`."""
    if stored is None:
        return df
    unknown = set(df.columns) - set(stored.columns)
    if strict and unknown:
        raise ValueError(f"columns not in the table: {', '.join(sorted(unknown))}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in stored.schema.fields
        ]
    )


def _store(
    df: DataFrame,
    target: str,
    stored: DataFrame | None,
    id_col: str | None,
    strict: bool = True,
    mode: str = "append",
    key: str | None = None,
) -> int:
    """Number, conform and write. Rows to be numbered, or that depend on what they replace,
    go through a copy in the shared folder, which is removed afterwards."""
    spark, copy = df.sparkSession, None
    partitions = partition_columns(spark, target) if stored is not None else []
    conform_to = stored if mode == "append" else None
    number = id_col is not None and id_col not in df.columns
    try:
        if number or (mode == "overwrite" and stored is not None):
            df = copy = materialize(df, "rows")
            if mode == "overwrite" and df.isEmpty():
                return 0
        if number:
            df = _numbered(df, conform_to, id_col)
        kept = [c for c in partitions if conform_to is not None or c in df.columns]
        return _write(_conform(df, conform_to, strict), target, mode, kept, key)
    finally:
        if copy is not None:
            discard(copy)


def ensure_table(
    spark: SparkSession,
    name: str,
    schema: str,
    partition_by: Sequence[str] = (),
    location: str | None = None,
    key: str | None = None,
    buckets: int | None = None,
) -> None:
    """Create a Parquet table with the columns of the DDL text `schema` unless it exists.

    Files of a table with a `key` get Bloom filters of it, which keyed writes look into. With
    `buckets` rows are stored by the key's hash, so that keyed writes of large batches need not
    shuffle what is stored; choose as many as a shuffle has partitions, or more.
    """
    if buckets is not None and key is None:
        raise ValueError("buckets need a key")
    ddl = f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet"
    if key is not None:
        ddl += f" OPTIONS ({', '.join(f'{_quoted(k)} = {_quoted(v)}' for k, v in _bloom(key).items())})"
    if partition_by:
        ddl += f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})"
    if buckets is not None:
        ddl += f" CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS"
    if location is not None:
        ddl += f" LOCATION '{location}'"
    spark.sql(ddl)


def append(df: DataFrame, target: str, id_col: str | None = None, key: str | None = None) -> int:
    """Append every row, without looking for duplicates; returns the rows written.

    `id_col` names a generated key: new rows get the ids that follow the stored ones. `key`
    names the column by which later writes will look rows up.
    """
    return _store(df, target, read_if_present(df.sparkSession, target), id_col, key=key)


def append_new(
    df: DataFrame,
    target: str,
    unique_col: str | None = None,
    if_exists: str = "append",
    dedup_within: bool = False,
    order: Sequence[str | Column] = (),
    id_col: str | None = None,
) -> int:
    """Append the rows whose `unique_col` is not stored yet; returns the rows written.

    Null counts as a value. Rows that share a new key are all written, unless
    `dedup_within` keeps the first of each by `order`. `if_exists` says what happens to
    a table that is already there: append, replace or fail. An empty batch never
    touches the table.
    """
    if if_exists not in _MODES:
        raise ValueError(f"if_exists must be one of {', '.join(_MODES)}")
    if dedup_within and not (unique_col and order):
        raise ValueError("dedup_within needs unique_col and order")
    if if_exists != "append" and df.isEmpty():
        return 0
    stored = read_if_present(df.sparkSession, target)
    if dedup_within:
        df = first_per_key(df, unique_col, *order)
    if unique_col is None or stored is None:
        return _store(df, target, stored, id_col, mode=_MODES[if_exists], key=unique_col)
    batch = materialize(df, "batch")  # is measured, looked up and written
    try:
        fresh = unseen(batch, stored, unique_col)
        return _store(fresh, target, stored, id_col, mode=_MODES[if_exists], key=unique_col)
    finally:
        discard(batch)


def insert_if_absent(
    df: DataFrame,
    target: str,
    key: str,
    order: Sequence[str | Column],
    id_col: str | None = None,
    skip_failed: bool = False,
    category_col: str = "category",
) -> int:
    """Insert the first row of every key that is not stored; returns the rows inserted.
    Columns the table does not have are left out.

    A null key conflicts with nothing, so those rows are all inserted. `skip_failed`
    leaves out rows labelled with a failure, so that they are tried again.
    """
    if skip_failed:
        failed = F.coalesce(F.col(category_col).isin(*fv.FAILURE_LABELS), F.lit(False))
        df = df.where(~failed)
    stored = read_if_present(df.sparkSession, target)
    df = first_per_key(df, key, *order, nulls_distinct=True)
    if stored is None:
        return _store(df, target, stored, id_col, strict=False, key=key)
    batch = materialize(df, "batch")
    try:
        fresh = unseen(batch, stored, key, null_safe=False)
        return _store(fresh, target, stored, id_col, strict=False, key=key)
    finally:
        discard(batch)


def update_table(
    spark: SparkSession,
    target: str,
    updates: DataFrame,
    key: str,
    columns: Sequence[str],
    order: Sequence[str | Column],
    location: str,
) -> int:
    """Write the updated rows of a table as a new snapshot at `location`.

    The snapshot is partitioned like the table. A catalog table is pointed at it once it
    is complete, and so is each of its partitions. Returns the number of rows that matched
    an update.
    """
    matched = Observation()
    partitions = partition_columns(spark, target)
    updated = update_by_key(read_table(spark, target), updates, key, columns, *order, flag="_matched")
    (
        updated.observe(matched, F.count(F.when(F.col("_matched"), 1)).alias("rows"))
        .drop("_matched")
        .write.mode("errorifexists")
        .partitionBy(*partitions)
        .parquet(location)
    )
    if not is_path(target):
        spark.sql(f"ALTER TABLE {target} SET LOCATION '{location}'")
        if partitions:
            _point_partitions(spark, target, location)
        spark.catalog.refreshTable(target)
    return int(matched.get["rows"])


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Overwrites replace the partitions they have rows for. The writer's option of that name does
    not hold for tables of the catalog, the session's setting does."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def update_partitions(
    spark: SparkSession,
    target: str,
    updates: DataFrame,
    key: str,
    columns: Sequence[str],
    order: Sequence[str | Column],
) -> int:
    """Update a partitioned table in place, rewriting only partitions that hold a row to be
    updated; returns the number of rows that matched an update.

    Keys and partition columns are read first, and tell which partitions match. Their new
    rows are written to the shared folder and then take the place of the old by dynamic
    partition overwrite, partition by partition; files of other partitions stay as they are.
    A run that dies in between is run again with the same updates.
    """
    partitions = partition_columns(spark, target)
    if not partitions:
        raise ValueError("the table has no partitions; use update_table")
    if set(partitions) & {*columns}:
        raise ValueError("rows cannot be moved between partitions")
    stored = read_table(spark, target)
    changes = materialize(updates, "updates")
    copies = [changes]
    try:
        keys = changes.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
        touched = (
            stored.select(key, *partitions)
            .join(broadcast_if_small(keys), F.col(key) == F.col("_key"), "left_semi")
            .select(*partitions)
            .distinct()
            .collect()
        )
        if not touched:
            return 0
        inside = any_of(F.col(partitions[0]), {row[0] for row in touched})
        if len(partitions) > 1:
            places = spark.createDataFrame(touched, stored.select(*partitions).schema)
            same = reduce(Column.__and__, [stored[p].eqNullSafe(places[p]) for p in partitions])
            old = stored.where(inside).join(F.broadcast(places), same, "left_semi")
        else:
            old = stored.where(inside)
        new = materialize(update_by_key(old, changes, key, columns, *order, flag="_matched"), "updated")
        copies.append(new)
        # gathers a partition in few files, and splits one that holds most rows
        rows = _conform(new.drop("_matched"), stored).hint("rebalance", *partitions)
        writer = rows.write.mode("overwrite").options(**_bloom(key))
        with _dynamic_overwrite(spark):
            if is_path(target):
                writer.partitionBy(*partitions).parquet(target)
            else:
                writer.insertInto(target)
                spark.catalog.refreshTable(target)
        return new.where("_matched").count()
    finally:
        discard(*copies)


def _point_partitions(spark: SparkSession, table: str, location: str) -> None:
    """Point every partition of a table into a new snapshot; those that have no rows there
    go, new ones come. This is one statement a partition, and moves no data."""
    for (folder,) in spark.sql(f"SHOW PARTITIONS {table}").collect():
        parts = [p.partition("=") for p in folder.split("/")]
        spec = ", ".join(f"`{unquote(name)}` = {_quoted(unquote(value))}" for name, _, value in parts)
        spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION {_quoted(f'{location}/{folder}')}")
    spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
