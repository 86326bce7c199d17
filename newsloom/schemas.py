"""Table and record schemas, as DDL text."""

PAGES = "url string, html string"

NEWS_RAW_DATA = (
    "id bigint, title string, link string, published_at timestamp_ntz, "
    "summary string, publisher string, content string"
)

NEWS_METADATA = (
    "id bigint, news_id bigint, title string, published_at timestamp_ntz, "
    "publisher string, category string"
)

# Vectors are plain float arrays; `metadata` is JSON text at rest.
NEWS_CHUNK_EMBEDDINGS = (
    "id bigint, news_id bigint, chunk_text string, embedding array<float>, metadata string"
)

CLASSIFIED = "struct<id: bigint, category: string>"

REFERENCE = "struct<news_id: bigint, title: string, publisher: string>"

CONTEXT = (
    "array<struct<news_id: bigint, similarity: double, chunk_text: string, "
    "full_article: string, meta_data: string, link: string>>"
)
