"""Continuous ingest of landed feed files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.extract import extract_pages
from newsloom.plans.steps import ingest_batch
from newsloom.session import discard, materialize
from newsloom.sources.feed import read_feed_stream
from newsloom.sources.tables import read_table

#: How long a link is remembered after it was last seen.
REMEMBER = dt.timedelta(days=30)


#: Groups in which links are remembered. A group costs a call a micro-batch, and what it remembers is
#: written when one of its links comes.
BUCKETS = 2048


def unseen_in_stream(
    entries: DataFrame, key: str = "link", remember: dt.timedelta = REMEMBER, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of a stream whose key no earlier micro-batch has brought.

    Keys are kept in the state store until they have not been seen for `remember`; then they
    count as new again, and whoever writes them has to look. Rows that share a key within one
    micro-batch all pass. A null key is never remembered, and rows without one are spread over
    the groups.

    The state is one row for each of `buckets` groups of keys by hash, with the keys themselves and
    when each is forgotten, so that calls do not grow with the keys. A checkpoint keeps the number
    it began with.
    """
    kept = int(remember.total_seconds() * 1000)
    names = entries.columns

    def pass_new(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        brought = {}
        if not state.hasTimedOut:
            until = state.getCurrentProcessingTimeMs() + kept
            for rows in batches:
                keys = rows[key].astype(object).where(rows[key].notna(), None).tolist()
                brought.update((k, until) for k in keys if k is not None)
                fresh = [k not in known for k in keys]
                if any(fresh):
                    yield rows.loc[fresh, names]
        mark = state.getCurrentWatermarkMs()
        known = {k: until for k, until in known.items() if until >= mark} | brought
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(max(min(known.values()), mark + 1))
        elif state.exists:
            state.remove()

    # rows without a key are told apart by the rest
    place = F.when(F.col(key).isNull(), F.xxhash64(*names)).otherwise(F.xxhash64(key))
    kind = entries.schema[key].dataType.simpleString()
    return (
        # the watermark is the time at which the latest rows were taken
        entries.select("*", F.pmod(place, F.lit(buckets)).alias("_bucket"), F.current_timestamp().alias("_taken"))
        .withWatermark("_taken", "0 seconds")
        .groupBy("_bucket")
        .applyInPandasWithState(
            pass_new, entries.schema, f"keys array<{kind}>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def ingest_stream(
    spark: SparkSession,
    feed_path: str,
    pages: str,
    raw: str,
    checkpoint: str,
    interval: str | None = None,
    max_files: int | None = None,
    page_order: str | None = None,
    extract: Callable[[DataFrame], DataFrame] = extract_pages,
    then: Callable[[int, int], None] | None = None,
    remember: dt.timedelta | None = REMEMBER,
) -> StreamingQuery:
    """Append the entries of new feed files, with publisher and content of their pages,
    to the table `raw`; links already stored are left out.

    Without `interval` the stream takes what has landed and stops; with one, such as
    "20 minutes", it keeps running. `then(batch_id, rows)` runs after each batch, for
    example to classify what came in. A batch that Spark repeats finds its links stored
    and adds nothing.

    Feeds bring the same entries again and again. Links seen within `remember` are dropped by
    the state store, so that a micro-batch without new ones does not look at `raw` at all, and
    one with a few looks for these alone; links seen longer ago are found by that. None keeps
    no state.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        # what is behind the state store must run once
        entries = materialize(batch, "entries")
        try:
            if entries.isEmpty():
                return
            stored_pages = read_table(batch.sparkSession, pages)
            rows = ingest_batch(entries, stored_pages, raw, page_order, extract)
            if then is not None:
                then(batch_id, rows)
        finally:
            discard(entries)

    entries = read_feed_stream(spark, feed_path, max_files=max_files)
    if remember is not None:
        entries = unseen_in_stream(entries, "link", remember)
    writer = entries.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
