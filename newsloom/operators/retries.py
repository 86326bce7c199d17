"""Failed articles are tried again, later each time, and not for ever.

A journal holds one row per article and failed attempt. How often an article failed and when
last tells when it is due again; the journal is only ever appended to, so that a repeated run
and a lost one leave it right.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.sizes import broadcast_if_small
from newsloom.sources.tables import read_if_present


class Retries(NamedTuple):
    journal: str  # table or path
    limit: int = 3  # attempts in all
    wait: dt.timedelta = dt.timedelta(minutes=20)  # after the first failure; doubled after each


_JOURNAL = "news_id bigint, status string, failed_at timestamp_ntz"


def _moment(now: dt.datetime) -> Column:
    return F.lit(now.isoformat(" ")).cast("timestamp_ntz")


def failures(spark: SparkSession, retries: Retries) -> DataFrame:
    """`news_id, attempts, due_at` of every article that has failed."""
    journal = read_if_present(spark, retries.journal)
    if journal is None:
        journal = spark.createDataFrame([], _JOURNAL)
    # attempts at one moment are one: a repeated write of a run
    seconds = F.lit(int(retries.wait.total_seconds()))
    counted = journal.groupBy("news_id").agg(
        F.countDistinct("failed_at").alias("attempts"), F.max("failed_at").alias("last")
    )
    wait = F.make_dt_interval(secs=seconds * F.pow(F.lit(2), F.least(F.col("attempts") - 1, F.lit(30))))
    return counted.select("news_id", "attempts", (F.col("last") + wait).alias("due_at"))


def due(articles: DataFrame, retries: Retries, now: dt.datetime) -> DataFrame:
    """`articles` without those that wait for their next attempt, or have had all of them."""
    failed = failures(articles.sparkSession, retries)
    waiting = failed.where((F.col("due_at") > _moment(now)) | (F.col("attempts") >= retries.limit))
    return articles.join(broadcast_if_small(waiting.select("news_id")), "news_id", "left_anti")


def settled(results: DataFrame, retries: Retries) -> DataFrame:
    """Results to be stored: labels, and the failures of articles that have no attempt left
    when this one is counted."""
    before = failures(results.sparkSession, retries).select(F.col("news_id").alias("_failed"), "attempts")
    joined = results.join(broadcast_if_small(before), F.col("news_id") == F.col("_failed"), "left")
    failed = F.coalesce(F.col("category").isin(*fv.FAILURE_LABELS), F.lit(False))
    last = F.coalesce("attempts", F.lit(0)) + 1 >= retries.limit
    return joined.where(~failed | last).select(*results.columns)


def failed_now(results: DataFrame, now: dt.datetime) -> DataFrame:
    """Journal rows of the results that failed."""
    return (
        results.where(F.col("category").isin(*fv.FAILURE_LABELS))
        .select("news_id", F.col("category").alias("status"), _moment(now).alias("failed_at"))
        .distinct()
    )
