"""The article model over the sample tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.embed import embed_chunks, embed_queries
from newsloom.providers import HashedTokenEmbedder


class Sample:
    """Model tables derived from one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.concat_ws("/", "source", "lang", "doc_id").alias("title"),
            F.concat(F.lit("doc://"), "doc_id").alias("link"),
            (
                F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                # days and the minutes left, as one count of minutes ends at 2**31 documents
                + F.make_dt_interval(
                    days=F.floor(F.col("doc_id") / 1440).cast("int"), mins=F.pmod("doc_id", F.lit(1440)).cast("int")
                )
            ).alias("published_at"),
            F.col("text").alias("summary"),
            F.col("source").alias("publisher"),
            F.col("text").alias("content"),
        )

    def articles(self) -> DataFrame:
        """Documents as handed to the classifier and the chunker."""
        return self.raw().select(
            F.col("id").alias("news_id"),
            "title",
            F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
            "publisher",
            F.lit(None).cast("string").alias("category"),
            "summary",
            "content",
        )

    def to_chunk(self) -> DataFrame:
        return self.articles().drop("summary")

    def metadata(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("news_id"),
            F.concat_ws(" ", "event_type", "event_id").alias("title"),
            F.col("ts").alias("published_at"),
            F.concat(F.lit("u"), "user_id").alias("publisher"),
            F.col("event_type").alias("category"),
        )

    def labelled(self) -> DataFrame:
        """Metadata of the labelled documents, so that a backlog remains."""
        return self.table("labels").select(F.col("doc_id").alias("news_id"))

    def chunks(self, news_id: str = "vec_id") -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col(news_id).cast("bigint").alias("news_id"),
            F.concat(F.lit("vector "), "vec_id", F.lit(" of label "), "label").alias("chunk_text"),
            "embedding",
            F.concat(
                F.lit('{"news_id":'), F.col(news_id),
                F.lit(',"title":"vector '), "vec_id",
                F.lit('","publisher":"label '), "label", F.lit('"}'),
            ).alias("metadata"),
        )

    def questions(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("query")
        )

    def queries(self) -> DataFrame:
        """Every question with its vector."""
        return embed_queries(self.questions(), HashedTokenEmbedder(64))

    def document_chunks(self) -> DataFrame:
        """Every document as one chunk with its vector."""
        chunks = self.raw().select(
            "id",
            F.col("id").alias("news_id"),
            F.col("content").alias("chunk_text"),
            F.to_json(F.struct(F.col("id").alias("news_id"), "title", "publisher")).alias("metadata"),
        )
        return embed_chunks(chunks, HashedTokenEmbedder(64))
