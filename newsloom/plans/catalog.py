"""Registered queries: every operator over whole sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_feed_date, stringify_timestamp
from newsloom.functions.html import page_parts
from newsloom.functions.text import classifier_text, split_sentences
from newsloom.functions.vectors import cosine_similarity
from newsloom.operators import (
    analytics,
    answer,
    backlog,
    cells,
    chunk,
    classify,
    clustered,
    constraints,
    daily,
    embed,
    extract,
    search,
)
from newsloom.operators.responses import ResponseLog
from newsloom.operators.upsert import first_per_key, unseen, update_by_key
from newsloom.plans.sample import Sample
from newsloom.plans.steps import answer_queries
from newsloom.providers import FirstHitAnswerer, HashedTokenEmbedder, KeywordClassifier, TextIds, Unsteady
from newsloom.schemas import CONTEXT
from newsloom.session import scratch, ship_package
from newsloom.sinks import append, ensure_table
from newsloom.sinks import append_new as append_new_rows
from newsloom.sinks import insert_if_absent as insert_rows
from newsloom.sinks import update_partitions as update_in_place
from newsloom.sources import attach_pages, full_articles, read_query
from newsloom.sources import read_feed as read_feed_
from newsloom.sources.feed import entries_of
from newsloom.streaming import ingest_stream as stream

Query = Callable[[SparkSession, str], DataFrame]

START, END = "2024-01-05", "2024-01-20"
CATEGORIES = ("click", "view", "purchase")
KEYWORDS = (("que", "生活"), ("sch", "國際"), ("the", "科技"))
DEFAULT_CATEGORY = "社會"
SENTENCE_END = "[.!?]"

_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Sample], DataFrame]) -> Callable[[Sample], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(Sample(spark, folder))

    _QUERIES[build.__name__.rstrip("_")] = run
    return build


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


# Sources


@_query
def read_query_(s: Sample) -> DataFrame:
    return read_query(
        s.spark,
        "SELECT category, publisher, count(*) AS articles FROM {metadata} GROUP BY category, publisher",
        metadata=s.metadata(),
    )


@_query
def read_feed(s: Sample) -> DataFrame:
    """Every document as an entry of a feed, in turn of RSS with references, RSS with marked
    sections, and Atom."""
    title = F.concat(F.col("title"), F.lit(" & \u00e9\u4e2d"))
    escaped = F.replace(F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;"))
    at = F.date_format("published_at", "dd MMM yyyy HH:mm:ss")
    plain = F.concat(
        F.lit("<title>"), F.replace(title, F.lit(" & \u00e9\u4e2d"), F.lit("&nbsp;&amp;&#32;&eacute;&#x4E2D;")),
        F.lit("</title><link>"), "link", F.lit("?a=1&amp;b</link><pubDate>"), at,
        F.lit("</pubDate><description>"), escaped, F.lit("</description></item>"),
    )
    marked = F.concat(
        F.lit("<title><![CDATA["), title, F.lit("]]></title><link> "), "link", F.lit("?a=1&b </link><pubDate>"), at,
        F.lit("</pubDate><description><![CDATA["), "content", F.lit("]]></description></item>"),
    )
    atom = F.concat(
        F.lit("<title type='text'>"), F.replace(title, F.lit("&"), F.lit("&amp;")),
        F.lit("</title><link rel='self' href='x'/><link href='"), "link", F.lit("?a=1&#38;b'/><updated>"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("</updated><content>"), escaped, F.lit("</content></item>"),
    )
    form = F.element_at(F.array(plain, marked, atom), (F.col("id") % 3 + 1).cast("int"))
    return entries_of(s.raw().select(F.concat(F.lit(">"), form).alias("value")), "item")


@_query
def read_feed_files(s: Sample) -> DataFrame:
    """Every document as an entry of feed files that are written and read: marked sections and
    comments hold tags that look like those of entries."""
    held = F.concat(
        F.lit("<item id='"), "id", F.lit("'><!-- <item><title>none</title></item> --><title><![CDATA["), "title",
        F.lit(" <item> & ]]></title><media:x/><link>"), "link", F.lit("</link><body><![CDATA[<p></item><item>]]>"),
        F.lit("</body><pubDate>"), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"),
        F.lit("</pubDate><description><![CDATA["), "content", F.lit("</item>]]> &lt;<![CDATA[<!-- ]]></description></item>"),
    )
    folder = scratch(s.spark, "feed")
    s.raw().select(held.alias("value")).write.text(folder)
    return read_feed_(s.spark, folder)


@_query
def attach_pages_(s: Sample) -> DataFrame:
    pages = s.table("pages")
    feed = s.raw().select("title", "link").union(
        pages.select(F.concat(F.lit("page "), "page_id"), "url")
    )
    landed = pages.select("url", F.length("html").cast("string").alias("page_length"))
    return attach_pages(feed, landed)


@_query
def full_articles_(s: Sample) -> DataFrame:
    return full_articles(s.raw(), s.chunks())


@_query
def parse_feed_date_(s: Sample) -> DataFrame:
    at = F.col("published_at")
    forms = F.array(
        F.concat(F.lit("Mon, "), F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" +0800")),
        F.concat(F.date_format(at, "dd-MMMM-yy HH:mm"), F.lit(" GMT")),
        F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
        F.concat(F.lit(" on "), F.date_format(at, "yyyy-MM-dd")),
    )
    text = F.element_at(forms, (F.col("news_id") % 4 + 1).cast("int"))
    return s.metadata().select("news_id", parse_feed_date(text).alias("published_at"))


# Keyed writes


@_query
def append_new(s: Sample) -> DataFrame:
    stored = s.labelled().select(F.concat(F.lit("doc://"), "news_id").alias("link"))
    return unseen(s.raw(), stored, "link").select("id", "link", "title")


@_query
def insert_if_absent(s: Sample) -> DataFrame:
    """Turns of conversations, every seventh without a key: those are all kept."""
    key = F.when(F.col("conv_id") % 7 != 3, F.col("conv_id")).alias("news_id")
    turns = s.table("conversations").select(key, "turn", "role", "text")
    first = first_per_key(turns, "news_id", "turn", nulls_distinct=True)
    return unseen(first, s.labelled(), "news_id", null_safe=False)


@_query
def update_by_key_(s: Sample) -> DataFrame:
    table = s.raw().select("id", "title", "publisher")
    updates = s.table("conversations").select(
        F.col("conv_id").alias("id"), "turn", F.col("text").alias("publisher")
    )
    return update_by_key(table, updates, "id", ["publisher"], "turn")


@_query
def append_new_table(s: Sample) -> DataFrame:
    """The labelled documents are appended to a new table, then all documents by link, twice; the
    table is read back."""
    table = f"articles_{uuid.uuid4().hex}"
    ensure_table(s.spark, table, "id bigint, link string, title string", location=scratch(s.spark, "table"), key="link")
    articles = s.raw().select("link", "title")
    stored = s.labelled().select(F.concat(F.lit("doc://"), "news_id").alias("link"), F.lit("old").alias("title"))
    append(stored, table, id_col="id")
    rows = [append_new_rows(articles, table, "link", id_col="id") for _ in range(2)]
    return s.spark.table(table).select("link", "title", F.lit(rows[1]).cast("bigint").alias("added_again"))


@_query
def insert_if_absent_table(s: Sample) -> DataFrame:
    """First turns of conversations, inserted beside the labels, of which none is replaced."""
    folder = scratch(s.spark, "table")
    append(s.labelled().select("news_id", F.lit("label").alias("role"), F.lit(None).cast("bigint").alias("turn")), folder)
    turns = s.table("conversations").select(F.col("conv_id").alias("news_id"), "role", "turn", "text")
    for _ in range(2):
        insert_rows(turns, folder, "news_id", ["turn"])
    return s.spark.read.parquet(folder)


@_query
def update_partitions(s: Sample) -> DataFrame:
    """Documents stored by publisher and language; conversations change the titles of some."""
    folder = scratch(s.spark, "table")
    articles = s.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "lang", "source")
    articles.write.partitionBy("lang", "source").parquet(folder)
    updates = s.table("conversations").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("title"))
    update_in_place(s.spark, folder, updates, "id", ["title"], ["turn"])
    return s.spark.read.parquet(folder).select("id", "title", "lang", "source")


@_query
def ingest_stream(s: Sample) -> DataFrame:
    """Every document lands in feed files, most of them again in a second wave; the stream takes
    each wave, and its table is read back."""
    folder = scratch(s.spark, "stream")
    raw = s.raw()
    entry = F.concat(
        F.lit("<item><title>"), "title", F.lit("</title><link>"), "link", F.lit("</link><pubDate>"),
        F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit("</pubDate></item>"),
    )
    page = F.concat(
        F.lit("<script type='application/ld+json'>{\"creator\":{\"@type\":\"Organization\",\"name\":\""), "publisher",
        F.lit("\"}}</script><div class='atoms'><p>article "), "id", F.lit("</p></div>"),
    )
    raw.where("id % 3 <> 1").select(F.col("link").alias("url"), page.alias("html")).write.parquet(f"{folder}/pages")
    first = raw.where("id % 2 = 0")
    for wave in (first, raw):
        wave.select(entry.alias("value")).write.mode("append").text(f"{folder}/landed")
        stream(
            s.spark, f"{folder}/landed", f"{folder}/pages", f"{folder}/raw", f"{folder}/checkpoint"
        ).awaitTermination()
    return s.spark.read.parquet(f"{folder}/raw").select("title", "link", "published_at", "publisher", "content")


@_query
def check_constraints(s: Sample) -> DataFrame:
    metadata = s.table("events").select(
        F.col("user_id").alias("news_id"), F.col("event_type").alias("category")
    )
    raw = s.table("labels").select(F.col("doc_id").alias("id"))
    return constraints.check_constraints(raw, metadata, s.chunks(), 32, CATEGORIES)


# Backlogs


@_query
def unclassified_backlog(s: Sample) -> DataFrame:
    return backlog.unclassified_backlog(s.raw(), s.labelled())


@_query
def unclassified_backlog_all(s: Sample) -> DataFrame:
    return backlog.unclassified_backlog(s.raw(), s.labelled(), limit=None)


@_query
def unembedded_backlog(s: Sample) -> DataFrame:
    return backlog.unembedded_backlog(s.raw(), s.metadata(), s.chunks())


@_query
def unembedded_backlog_all(s: Sample) -> DataFrame:
    return backlog.unembedded_backlog(s.raw(), s.metadata(), s.chunks(), limit=None)


@_query
def stringify_timestamp_(s: Sample) -> DataFrame:
    return s.metadata().select("news_id", stringify_timestamp(F.col("published_at")).alias("published_at"))


# Pages


def _marked_pages(s: Sample) -> DataFrame:
    """The pages with linked data and a description made from their address put into their
    heads, and the articles of every other page in the container."""
    secure = F.col("url").startswith("https")
    party = F.when(secure, "Organization").otherwise("Person")
    head = F.concat(
        F.lit("<head><!-- <script type='application/ld+json'>{}</script> --><script type='application/ld+json' id='>'>"),
        F.lit('{"creator":{"@type":"'), party,
        F.lit('","name":"'), "url", F.lit('"},"provider":{"@type":"Organization","name":"page '),
        "page_id", F.lit('"}}</script><meta content="'), "url", F.lit('" name="description">'),
    )
    page = F.replace("html", F.lit("<head>"), head)
    held = F.replace(
        F.replace(page, F.lit("<article>"), F.lit("<div class='x atoms'>")), F.lit("</article>"), F.lit("</div>")
    )
    return s.table("pages").select(
        "page_id", F.when(F.col("page_id") % 2 == 0, held).otherwise(page).alias("html")
    )


@_query
def article_body(s: Sample) -> DataFrame:
    parts = page_parts(F.col("html"), "article", None)
    return s.table("pages").select("page_id", extract.article_body(parts).alias("content"))


@_query
def first_json_ld(s: Sample) -> DataFrame:
    return _marked_pages(s).select(
        "page_id", extract.first_json_ld(F.col("html")).alias("json_ld")
    )


@_query
def extract_pages(s: Sample) -> DataFrame:
    return extract.extract_pages(_marked_pages(s))


# Classification


@_query
def classifier_text_(s: Sample) -> DataFrame:
    return s.articles().select(
        "news_id", classifier_text(F.col("title"), F.col("summary")).alias("summary")
    )


def _batches(s: Sample) -> DataFrame:
    return classify.make_batches(s.articles(), bucket=F.floor(F.col("news_id") / 480))


@_query
def make_batches(s: Sample) -> DataFrame:
    return _batches(s).select("bucket", "batch", F.size("ids").alias("articles"), "items")


@_query
def render_classify_prompt(s: Sample) -> DataFrame:
    prompt = classify.render_classify_prompt(
        F.col("items"), CATEGORIES, "Categories: {categories}. Articles: {items}"
    )
    return _batches(s).select("bucket", "batch", prompt.alias("prompt"))


def _classified(s: Sample) -> DataFrame:
    return classify.classify_articles(
        s.articles().select("news_id", "title", "summary"),
        KeywordClassifier(KEYWORDS, DEFAULT_CATEGORY),
    )


@_query
def classify_batches(s: Sample) -> DataFrame:
    """A model that fails in every way, asked once for each batch."""
    prompt = classify.render_classify_prompt(
        F.col("items"), CATEGORIES, "Categories: {categories}. Articles: {items}"
    )
    model = Unsteady(KeywordClassifier(KEYWORDS, DEFAULT_CATEGORY), ("error", "empty", "[{", "5", None))
    asked = _batches(s).withColumn("prompt", prompt)
    return classify.explode_classified(classify.classify_batches(asked, model, attempts=1)).select("id", "category")


@_query
def classify_backlog(s: Sample) -> DataFrame:
    waiting = backlog.unclassified_backlog(s.raw(), s.labelled(), limit=None)
    results = classify.classify_articles(waiting, KeywordClassifier(KEYWORDS, DEFAULT_CATEGORY))
    return classify.join_back(results.select("id", "category"), waiting.drop("summary"))


@_query
def classify_articles(s: Sample) -> DataFrame:
    return _classified(s).select("id", "category")


@_query
def join_back(s: Sample) -> DataFrame:
    facts = s.articles().select("news_id", "title", "published_at", "publisher")
    return classify.join_back(_classified(s).select("id", "category"), facts)


# Chunks and vectors


@_query
def split_sentences_(s: Sample) -> DataFrame:
    return s.articles().select(
        "news_id",
        F.posexplode(split_sentences(F.col("content"), SENTENCE_END)).alias("place", "sentence"),
    )


def _chunks(s: Sample) -> DataFrame:
    return chunk.chunk_articles(s.to_chunk(), delimiters=SENTENCE_END)


@_query
def chunk_articles(s: Sample) -> DataFrame:
    return _chunks(s).select("news_id", "chunk_idx", "chunk_text", "status")


@_query
def no_content_marker(s: Sample) -> DataFrame:
    emptied = (
        F.when(F.col("title").contains("/fr/"), F.lit(""))
        .when(F.col("title").contains("/de/"), F.lit(" 　\n"))
        .when(~F.col("title").contains("/es/"), F.col("content"))
    )
    chunks = chunk.chunk_articles(s.to_chunk().withColumn("content", emptied), delimiters=SENTENCE_END)
    marked = F.col("status").isNotNull()
    return chunks.groupBy("news_id", "status").agg(
        F.count(F.when(marked, 1)).alias("markers"), F.max("chunk_idx").alias("last_chunk")
    )


@_query
def chunk_metadata(s: Sample) -> DataFrame:
    return chunk.chunk_metadata(_chunks(s))


@_query
def embed_chunks(s: Sample) -> DataFrame:
    chunks = s.articles().select("news_id", F.col("content").alias("chunk_text"))
    return embed.embed_chunks(chunks, HashedTokenEmbedder(64)).select(
        "news_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")
    ).select("news_id", "dim", F.round("value", 6).alias("value"))


@_query
def embed_logged(s: Sample) -> DataFrame:
    """Every document embedded through a log of vectors, twice: the second run asks for none."""
    log = ResponseLog(scratch(s.spark, "vectors"), "hashed tokens, 64")
    chunks = s.articles().select("news_id", F.col("content").alias("chunk_text"))
    for _ in range(2):
        found = embed.embed_chunks(chunks, HashedTokenEmbedder(64), log=log)
    return found.select(
        "news_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")
    ).select("news_id", "dim", F.round("value", 6).alias("value"))


@_query
def embed_backlog(s: Sample) -> DataFrame:
    waiting = backlog.unembedded_backlog(s.raw(), s.metadata(), s.chunks(), limit=None)
    chunks = chunk.chunk_articles(waiting, delimiters=SENTENCE_END)
    vectors = embed.embed_chunks(chunks.select("news_id", "chunk_idx", "chunk_text"), HashedTokenEmbedder(64))
    return vectors.select(
        "news_id", "chunk_idx", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")
    ).where("value > 0").select("news_id", "chunk_idx", "dim", F.round("value", 6).alias("value"))


@_query
def embed_queries(s: Sample) -> DataFrame:
    asked = s.table("conversations").select(
        "conv_id", "turn", F.col("text").alias("query")
    )
    return embed.embed_queries(asked, HashedTokenEmbedder(64)).select(
        "conv_id", "turn", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")
    )


# Search


@_query
def cosine_similarity_(s: Sample) -> DataFrame:
    vectors = s.table("embeddings")
    a = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = vectors.select((F.col("vec_id") - 1).alias("previous"), F.col("embedding").alias("b"))
    return a.join(b, F.col("id") == F.col("previous")).select(
        "id", F.round(cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity")
    )


@_query
def search_top_k(s: Sample) -> DataFrame:
    query = s.table("embeddings").orderBy("vec_id").select("embedding").first()[0]  # one vector is the feature
    return _rounded(search.search_top_k(s.chunks(), s.raw(), query))


@_query
def search_top_k_batch(s: Sample) -> DataFrame:
    return _rounded(search.search_top_k_batch(s.chunks(), s.raw(), s.queries()))


@_query
def search_pruned(s: Sample) -> DataFrame:
    """`search_top_k_batch` over an index that is built and read back."""
    index = cells.build_cells(s.chunks(), scratch(s.spark, "cells"), block_rows=64)
    return _rounded(cells.search_pruned(index, s.chunks(), s.raw(), s.queries()))


def _label_hits(s: Sample) -> tuple[DataFrame, int]:
    """Hits of every query and their greatest number; labels are the articles, so that
    many queries hit few of them."""
    queries = s.queries()
    return search.nearest_batch(s.chunks("label"), queries), s.questions().count() * 5


def _enriched(s: Sample) -> DataFrame:
    raw, (hits, bound) = s.raw(), _label_hits(s)
    found = search.attach_chunks(hits, s.chunks("label"), bound)
    linked = search.attach_links(found, raw, bound, ids=hits)
    return search.enrich_full_article(linked, raw, max_hits=bound, ids=hits)


@_query
def enrich_full_article(s: Sample) -> DataFrame:
    hits, bound = _label_hits(s)
    return search.enrich_full_article(hits, s.raw(), max_hits=bound).select(
        "query_id", "rank", "news_id", "full_article"
    )


def _context(s: Sample) -> DataFrame:
    results = search.build_context(_enriched(s))
    return results.withColumn("context", answer.context_json(F.col("results")))


@_query
def build_context(s: Sample) -> DataFrame:
    return _context(s).select("query_id", F.size("results").alias("hits"), "context")


@_query
def metadata_search(s: Sample) -> DataFrame:
    return search.metadata_search(
        s.metadata(), s.raw(), category="purchase", start=f"{START} 06:00:00", end=f"{END} 18:00:00"
    )[1]


@_query
def metadata_search_total(s: Sample) -> DataFrame:
    return search.metadata_search(s.metadata(), s.raw(), publisher="u7", end=END)[0]


@_query
def metadata_pages(s: Sample) -> DataFrame:
    """All pages of a search, one after the other, over metadata stored along a curve."""
    folder = scratch(s.spark, "metadata")
    clustered.write_clustered(s.metadata(), folder)
    metadata, raw = s.spark.read.parquet(folder), s.raw()
    size, after, pages = max(50, metadata.count() // 40), None, []
    while not pages or after is not None:
        page = clustered.metadata_page(
            metadata, raw, size, after, category="purchase", start=f"{START} 06:00:00", end=f"{END} 18:00:00"
        )
        pages.append(page.rows)
        after = page.after
    return reduce(DataFrame.union, pages)


# Answers


def _prompts(s: Sample) -> DataFrame:
    prompt = answer.render_answer_prompt(
        F.col("query"), F.col("context"), "Question: {query} Articles: {results} Answer:"
    )
    return s.questions().join(_context(s), "query_id").withColumn("prompt", prompt)


@_query
def render_answer_prompt(s: Sample) -> DataFrame:
    return _prompts(s).select("query_id", "prompt")


@_query
def parse_answer(s: Sample) -> DataFrame:
    """A model that fails in every way; the answers that come name articles by text."""
    model = Unsteady(TextIds(FirstHitAnswerer()), ("error", "empty", '{"summary": ', "[]", None, None, None))
    responses = answer.generate_answers(_prompts(s), model)
    parsed = answer.parse_answer(F.col("response"), F.col("status"))
    return responses.select("query_id", parsed.alias("a")).select(
        "query_id",
        "a.summary",
        F.array_join(F.transform("a.references", lambda r: r["news_id"].cast("string")), ",").alias("references"),
        "a.status",
    )


def _answered(s: Sample) -> DataFrame:
    """One row per document as a query; those without a vector have no hits."""
    asked = s.raw().select(F.col("id").alias("query_id")).join(_prompts(s), "query_id", "left")
    answers = answer.generate_answers(asked, FirstHitAnswerer())
    return answers.select(
        "query_id",
        F.coalesce("results", F.array().cast(CONTEXT)).alias("results"),
        F.when(F.col("results").isNull(), answer.no_hits_answer())
        .otherwise(answer.parse_answer(F.col("response"), F.col("status")))
        .alias("answer"),
    )


@_query
def answer_questions(s: Sample) -> DataFrame:
    """All questions against all documents, from vectors to rendered answers."""
    return answer_queries(
        s.questions(), s.document_chunks(), s.raw(), HashedTokenEmbedder(64), FirstHitAnswerer()
    ).select("query_id", F.size("results").alias("hits"), "answer.status", "text")


@_query
def resolve_references(s: Sample) -> DataFrame:
    resolved = answer.resolve_references(F.col("answer.references"), F.col("results"))
    return _answered(s).select("query_id", F.posexplode(resolved).alias("place", "r")).select(
        "query_id", "place", "r.news_id", "r.title", "r.publisher", "r.link"
    )


@_query
def render_answer(s: Sample) -> DataFrame:
    resolved = answer.resolve_references(F.col("answer.references"), F.col("results"))
    return _answered(s).select(
        "query_id",
        F.col("answer.status").alias("status"),
        answer.render_answer(F.col("answer.summary"), resolved).alias("text"),
    )


# Analytics


@_query
def date_bounds(s: Sample) -> DataFrame:
    return analytics.in_range(s.metadata(), START, END).select("news_id", "published_at")


@_query
def top_categories(s: Sample) -> DataFrame:
    return analytics.top_categories(s.metadata(), START, END, 3)


@_query
def top_publishers(s: Sample) -> DataFrame:
    return analytics.top_publishers(s.metadata(), START, END)


@_query
def total_in_range(s: Sample) -> DataFrame:
    return analytics.total_in_range(s.metadata(), START, END)


@_query
def trend_table(s: Sample) -> DataFrame:
    return analytics.trend_table(s.metadata(), START, END)


def _report(report: analytics.TrendReport) -> DataFrame:
    return (
        report.categories.select(F.lit("category").alias("kind"), F.col("category").alias("name"), "count")
        .union(report.publishers.select(F.lit("publisher"), "publisher", "count"))
        .union(report.summary.select(F.lit("sentence"), "sentence", "total"))
    )


@_query
def trend_report(s: Sample) -> DataFrame:
    return _report(analytics.trend_report(s.metadata(), START, END))


@_query
def daily_report(s: Sample) -> DataFrame:
    """The report from counts kept by day: one batch comes with wrong categories that are put
    right, the other is recorded twice."""
    folder, metadata = scratch(s.spark, "daily"), s.metadata()
    first, rest = metadata.where("id % 3 = 0"), metadata.where("id % 3 <> 0")
    wrong = first.withColumn("category", F.lit("unknown")).withColumn("published_at", F.expr("published_at - interval 9 days"))
    daily.record(wrong, folder, "first")
    daily.record(rest, folder, "rest")
    daily.record(rest, folder, "rest")
    daily.record_change(wrong, first, folder, "mended")
    return _report(daily.trend_report(s.spark.read.parquet(folder), START, END))
