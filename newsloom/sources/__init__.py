from newsloom.sources.feed import attach_pages, read_feed, read_feed_stream
from newsloom.sources.tables import full_articles, read_jdbc, read_query, read_table

__all__ = [
    "attach_pages",
    "full_articles",
    "read_feed",
    "read_feed_stream",
    "read_jdbc",
    "read_query",
    "read_table",
]
