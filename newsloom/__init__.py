"""Article collections on Spark: ingest, classify, chunk, embed, search, answer, count."""
