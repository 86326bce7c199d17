"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Source s has the weight `w_s(t)`, a line from its start to
its end multiplier. Its integral, scaled to the source's target, is the demand for its
words up to t. Documents of a source stand in the order of a hash; the words before a
document are the demand at which it is due, and the inverse of the integral turns that into
its training position. Sorting by position by range gives the training order.

The words before a document are a sum over its source, which may hold most of all rows. So
each source is cut into 4096 bins by the leading digits of the hash: bins are added up
first, then the rows within a bin. No source meets in one task, only its bins' totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, column, free_name, word_count
from newsloom.session import materialize

WEIGHTS = (5, 2, 1)
#: Start and end multiplier of the weight over training time, repeating like the weights.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE = 1.5
CAP = 2
_BIN_DIGITS = 3


def source_targets(
    totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """Adds rank, weight and target to a table of one row per source with its `source_size`.

    Sources stand in code point order, null last, and take the weights in turn. They share
    `share` times all sizes by weight; a target stops at `cap` times its source's size, and
    what is left over goes to the others by weight. In closed form: sources sorted by the
    level at which they stop; the common level is that of the first source that it does not
    fill. This is a table of sources, not of documents, so that its windows need no key.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = totals.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
        ),
    )
    limit = cap * F.col("source_size")
    by_level = Window.orderBy("full_at", "rank")
    everything = Window.partitionBy()
    leveled = (
        named.withColumn("full_at", limit / F.col("weight"))
        .withColumn(
            "left",
            F.sum("source_size").over(everything) * share
            - (F.sum(limit).over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - limit),
        )
        .withColumn("weights", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("weights"))
    )
    common = F.first(
        F.when(F.col("level") <= F.col("full_at"), F.col("level")), ignorenulls=True
    ).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn(
        "target", F.least(limit.cast("double"), common * F.col("weight"))
    ).select("source", "rank", "weight", "source_size", "target")


def due_time(part: Column, start: Column, end: Column) -> Column:
    """Time at which a weight running from `start` to `end` has used up `part` of its integral."""
    mean = (start + end) / 2
    bend = (end - start) / 2
    root = F.sqrt(start * start + 4 * bend * mean * part)
    return F.when(part == 0, 0.0).otherwise(2 * mean * part / (start + root))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    schedule: Sequence[tuple[float, float]] = SCHEDULE,
    prefix: str = "mix_",
) -> DataFrame:
    """All rows and columns of `docs`, with size, source_size, target, before, goal, taken,
    start and end under `prefix`.

    Documents are taken in the order of a hash of id and text, pass after pass, until the
    target is reached to the word; the last document of a source gives a part. Null and
    empty texts have size 0 and are never taken. A null source is a source. Repeated rows
    are documents of their own, and interchangeable. An empty table gives an empty result.
    """
    id_, text, source = column(id_col), column(text_col), column(source_col)
    # of id and text, so that rows without an id, or of the same one, have places of their own
    key = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    p = prefix
    sized = docs.withColumns({f"{p}size": word_count(text), f"{p}key": key}).withColumn(
        f"{p}bin", F.substring(f"{p}key", 1, _BIN_DIGITS)
    )
    bins = materialize(
        sized.groupBy(source.alias("source"), F.col(f"{p}bin").alias("bin")).agg(
            F.sum(f"{p}size").alias("bin_size")
        ),
        "bins",
    )
    sources = source_targets(
        bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, cap
    )
    turn = (F.col("rank") % len(schedule) + 1).cast("int")
    sources = sources.select(
        F.col("source").alias("known"),
        F.col("source_size").alias(f"{p}source_size"),
        F.col("target").alias(f"{p}target"),
        F.element_at(F.array(*[F.lit(float(a)) for a, _ in schedule]), turn).alias(f"{p}start"),
        F.element_at(F.array(*[F.lit(float(b)) for _, b in schedule]), turn).alias(f"{p}end"),
    )
    in_order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bins.withColumn("earlier", F.coalesce(F.sum("bin_size").over(in_order), F.lit(0)))
        .join(sources, F.col("source").eqNullSafe(F.col("known")))
        .select(
            F.col("source").alias(f"{p}source"),
            F.col("bin").alias(f"{p}of"),
            F.col("earlier").alias(f"{p}earlier"),
            f"{p}source_size",
            f"{p}target",
            f"{p}start",
            f"{p}end",
        )
    )
    within = (
        Window.partitionBy(f"{p}source", f"{p}of")
        .orderBy(f"{p}key", id_.asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    size, whole = F.col(f"{p}size"), F.col(f"{p}source_size")
    placed = (
        sized.join(starts, source.eqNullSafe(F.col(f"{p}source")) & (F.col(f"{p}bin") == F.col(f"{p}of")))
        .withColumn(f"{p}before", F.col(f"{p}earlier") + F.sum(f"{p}size").over(within) - size)
        .withColumn(f"{p}goal", F.floor(F.col(f"{p}target") + 0.5))
    )
    taken = sum(
        (
            F.greatest(F.lit(0), F.least(size, F.col(f"{p}goal") - F.lit(turn) * whole - F.col(f"{p}before")))
            for turn in range(cap)
        ),
        F.lit(0),
    )
    return placed.withColumn(f"{p}taken", taken.cast("long")).drop(
        f"{p}key", f"{p}bin", f"{p}source", f"{p}of", f"{p}earlier"
    )


def position(turn: Column, prefix: str = "mix_") -> Column:
    """Training position of the pass `turn` (0 for the first) over a row of `mix`."""
    p = prefix
    part = (turn * F.col(f"{p}source_size") + F.col(f"{p}before")) / F.col(f"{p}target")
    return due_time(part, F.col(f"{p}start"), F.col(f"{p}end"))


def in_training_order(placed: DataFrame, position_col: str, id_col: str) -> DataFrame:
    """Rows sorted by range of their training position, then id."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [column(position_col).asc_nulls_last(), column(id_col)]
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order)


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cap: int = CAP,
    **options,
) -> DataFrame:
    """The mix itself: the columns of `docs`, one row per copy taken, in training order.

    A copy that is taken in part keeps its first words, one blank between them. Documents of no words have no place.
    """
    prefix = free_name(docs, "mix_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    p = prefix
    placed = mix(docs, id_col, text_col, source_col, cap=cap, prefix=p, **options)
    size, goal = F.col(f"{p}size"), F.col(f"{p}goal")
    copies = placed.withColumn(f"{p}turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn(
        f"{p}words",
        F.least(size, goal - F.col(f"{p}turn") * F.col(f"{p}source_size") - F.col(f"{p}before")),
    )
    copies = copies.filter(F.col(f"{p}words") > 0).withColumn(f"{p}position", position(F.col(f"{p}turn"), p))
    words = F.regexp_extract_all(column(text_col), F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col(f"{p}words").cast("int")), " ")
    cut = copies.withColumn(
        text_col, F.when(F.col(f"{p}words") < size, part).otherwise(column(text_col))
    )
    return in_training_order(cut, f"{p}position", id_col).select(*[column(c) for c in docs.columns])
