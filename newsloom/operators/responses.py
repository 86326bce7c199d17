"""Answers of models, kept by the content of the question.

A log is a folder of answers under a hash of the model's name and of all that the model is
handed. What is in it is not asked again: not for an equal question in the same table, nor by
a run after one that was killed. Questions that are not there are asked in rounds, and each
round is one committed write, so that a lost run loses one round at most. Answers that are no
answers, such as an error, are given back to the caller but count as missing later.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import discard, materialize
from newsloom.sources.tables import read_if_present


class ResponseLog(NamedTuple):
    folder: str
    model: str  # name and version; another one asks anew
    round_rows: int = 10_000


_KEY = "_question"


def content_key(model: str, *parts: Column) -> Column:
    """Hash of a model's name and the texts it is handed; lengths keep the texts apart."""
    texts = [F.lit(model), *parts]
    return F.sha2(
        F.concat(*[F.concat(F.coalesce(F.length(t).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(t, F.lit(""))) for t in texts]),
        256,
    )


def _ask_in_rounds(
    questions: DataFrame,
    new: DataFrame,
    log: ResponseLog,
    rounds: int,
    ask: Callable[[DataFrame], DataFrame],
    outputs: Sequence[str],
    answered: Column,
) -> None:
    """Ask the questions whose key is in `new`, each once, and add the answers to the log. The
    questions are stored by round, so that a round reads its own only."""
    turn = F.pmod(F.xxhash64(_KEY), F.lit(rounds)).cast("int")
    missing = (
        questions.dropDuplicates([_KEY])
        .join(new, _KEY, "left_semi")
        .withColumn("_round", turn)
        .hint("rebalance", "_round")
    )
    missing = materialize(missing, "missing", "_round")
    for i in range(rounds):
        (
            ask(missing.where(F.col("_round") == i).drop("_round"))
            .select(
                _KEY,
                F.lit(log.model).alias("model"),
                *outputs,
                F.coalesce(answered, F.lit(False)).alias("answered"),
                F.current_timestamp().alias("asked_at"),
            )
            .hint("rebalance")  # as many tasks ask as there are; few files are written
            .write.mode("append")
            .option(f"parquet.bloom.filter.enabled#{_KEY}", "true")
            # without it, each file has a filter for as many keys as fit in 1 MB
            .option(f"parquet.bloom.filter.expected.ndv#{_KEY}", str(log.round_rows))
            .parquet(log.folder)
        )
    discard(missing)


def logged(
    rows: DataFrame,
    log: ResponseLog,
    inputs: Sequence[str],
    ask: Callable[[DataFrame], DataFrame],
    outputs: Sequence[str],
    answered: Column,
) -> DataFrame:
    """`rows` with the columns `outputs` that `ask` adds to a frame of `inputs`, from the log where
    it has them. Where `answered` is false an answer is not used again. A null first input is no
    question, and has no outputs.

    The result reads the log and a copy of `rows` in the shared folder.
    """
    spark = rows.sparkSession
    keyed = materialize(rows.withColumn(_KEY, content_key(log.model, *[F.col(c) for c in inputs])), "questions")
    questions = keyed.where(F.col(inputs[0]).isNotNull())
    # keys alone tell how many rounds there are, so that a table that is all there is not shuffled
    keys = questions.select(_KEY).distinct()
    stored = read_if_present(spark, log.folder)
    if stored is not None:
        keys = keys.join(stored.where("answered").select(_KEY).distinct(), _KEY, "left_anti")
    new = materialize(keys, "new")
    rounds = -(-new.count() // log.round_rows)
    if rounds:
        _ask_in_rounds(questions.select(_KEY, *inputs), new, log, rounds, ask, outputs, answered)
    discard(new)
    stored = read_if_present(spark, log.folder)
    if stored is None:
        empty = ask(keyed.limit(0)).select(*outputs).schema
        return keyed.select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty])
    order = F.struct("answered", "asked_at")
    latest = (
        stored.join(keyed.select(_KEY).distinct(), _KEY, "left_semi")
        .groupBy(_KEY)
        .agg(F.max_by(F.struct(*outputs), order).alias("_answer"))
        # a second key, so that the join stands behind the aggregation and a question that very
        # many rows ask can be split
        .withColumn("_hash", F.xxhash64(_KEY))
    )
    found = keyed.withColumn("_hash", F.xxhash64(_KEY)).join(latest, [_KEY, "_hash"], "left")
    return found.select(*rows.columns, *[F.col(f"_answer.`{c}`").alias(c) for c in outputs])
