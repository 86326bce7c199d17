"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    bitsliced,
    exact,
    html_text,
    lines,
    mixing,
    negatives,
    ngram_lm,
    packing,
    prefix_trie,
    repetition,
    secrets,
    sharding,
    simhash,
)
from newsloom.llm.sql import SQL
from newsloom.session import materialize, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Tables of the queries that do not read documents.
_TABLES = {"op9": "pages", "op11": "conversations", "op12": "embeddings", "op13": "embeddings"}


def _query(build: Callable[[DataFrame], DataFrame]):
    table = _TABLES.get(build.__name__.partition("_")[0], "documents")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

    QUERIES[build.__name__] = run
    return build


@_query
def op1_line_templates(docs: DataFrame) -> DataFrame:
    kept = lines.drop_recurring_lines(docs, dropped_col="n_dropped")
    return kept.select(
        "doc_id",
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@_query
def op2_curriculum_mix(docs: DataFrame) -> DataFrame:
    mixed = mixing.mix(docs)
    placed = mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.when(F.col("mix_taken") > 0, mixing.position(F.lit(0))).alias("first_position"),
    )
    return mixing.in_training_order(materialize(placed, "placed"), "first_position", "doc_id")


@_query
def op3_repetition_rules(docs: DataFrame) -> DataFrame:
    return repetition.repetition_rules(docs)


#: Folder of the public vocabulary files.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@_query
def op4_bm25_packing(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


@_query
def op5_bloom_dedup(docs: DataFrame) -> DataFrame:
    return exact.mark_copies(docs)


@_query
def op6_backoff_scores(docs: DataFrame) -> DataFrame:
    scores = ngram_lm.backoff_scores(docs)
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


@_query
def op6_trigram_scores(docs: DataFrame) -> DataFrame:
    scores = ngram_lm.backoff_scores(docs, order=3)
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


@_query
def op7_simhash_dedup(docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(docs)


@_query
def op8_secret_formats(docs: DataFrame) -> DataFrame:
    return secrets.find_secrets(docs)


@_query
def op9_layout_text(pages: DataFrame) -> DataFrame:
    return html_text.extract_text(pages)


@_query
def op10_virtual_slots(docs: DataFrame) -> DataFrame:
    return sharding.shard_documents(docs)


@_query
def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie.prefix_trie(conversations)


@_query
def op12_bitsliced_top_k(vectors: DataFrame) -> DataFrame:
    return bitsliced.exact_top_k(vectors)


@_query
def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(vectors, label=relabelled)


assert set(SQL) <= set(QUERIES)
