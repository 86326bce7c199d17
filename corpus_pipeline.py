"""From raw documents to packed sequences: the corpus operators in a row, each stage written
to the shared folder before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import queries
from newsloom.llm.lines import drop_recurring_lines
from newsloom.llm.mixing import mixed_documents
from newsloom.llm.packing import pack
from newsloom.llm.repetition import keep_varied
from newsloom.llm.simhash import drop_near_duplicates
from newsloom.session import materialize, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    ship_package(spark)
    return keep_varied(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across them."""
    return drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    ship_package(spark)
    return pack(docs, queries.TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: The packing order follows retrieval scores, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    *earlier, (_, last) = STAGES
    for name, stage in earlier:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
