import datetime as dt

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.dates import parse_feed_date
from newsloom.plans.steps import ingest_batch
from newsloom.sinks import ensure_table
from newsloom.sources import attach_pages, read_feed, read_query
from newsloom.streaming import ingest_stream


def feed(*items):
    return "<?xml version='1.0' encoding='UTF-8'?><rss><channel><title>feed</title>%s</channel></rss>" % "".join(
        "<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in item.items()) + "</item>" for item in items
    )


def item(n, **extra):
    return {
        "title": f"標題 {n}", "link": f"http://n/{n}", "pubDate": "Mon, 07 Jul 2025 03:04:05 GMT",
        "description": f"<![CDATA[summary & {n}]]>", **extra,
    }


PAGE = '<script type="application/ld+json">{"creator":{"@type":"Organization","name":"Org"}}</script>' \
       '<div class="atoms"><p>body %s</p></div>'


def test_read_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(feed(item(1), {"link": "http://n/2"}), encoding="utf-8")
    got = {r.link: r for r in read_feed(spark, str(tmp_path)).collect()}
    assert got["http://n/1"] == ("標題 1", "http://n/1", dt.datetime(2025, 7, 7, 3, 4, 5), "summary & 1")
    assert got["http://n/2"] == (None, "http://n/2", None, None)


def test_broken_feed_costs_only_the_broken_entry(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss xmlns:media='m'><channel><title>feed</title>"
        "<item><title>a &amp; b</title><link> http://n/1?x=1&amp;y=2 </link><media:content url='z'/></item>"
        "<item><title>c & d &nbsp; e</title><link>http://n/2?x=1&y=2</link></item>"
        "<item><title>open <b>tag</title><link>http://n/3</link></item>"
        "<item attr='1'><description><![CDATA[<p>f & g</p>]]></description></item>"
        "<item></item><item><title>cut off",
        encoding="utf-8",
    )
    (tmp_path / "b.xml").write_text("", encoding="utf-8")
    got = [(r.title, r.link, r.summary) for r in read_feed(spark, str(tmp_path)).collect()]
    assert got == [
        ("a & b", "http://n/1?x=1&y=2", None),
        ("c & d \xa0 e", "http://n/2?x=1&y=2", None),
        ("open <b>tag", "http://n/3", None),
        (None, None, "<p>f & g</p>"),
        (None, None, None),
    ]


def test_references_and_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<feed xmlns='http://www.w3.org/2005/Atom'><title>feed</title><entry><title type='html'>A&nbsp;B &#39;q&#x27; &euro; "
        "&#128512; &unknown; <![CDATA[&amp; x]]></title><link rel='self' href='http://n/s'/>"
        "<link rel='alternate' href='http://n/1?a=1&amp;b=2'/><published>2025-07-07T03:04:05Z</published>"
        "<summary>s</summary></entry><entry>\n<title/><link href=\"http://n/2\"/><updated>2025-07-08T00:00:00Z</updated>"
        "<content>c</content></entry></feed>",
        encoding="utf-8",
    )
    assert sorted(map(tuple, read_feed(spark, str(tmp_path), "entry").collect()), key=repr) == [
        ("A\xa0B 'q' € 😀 &unknown; &amp; x".replace("q'", "q'"), "http://n/1?a=1&b=2", dt.datetime(2025, 7, 7, 3, 4, 5), "s"),
        (None, "http://n/2", dt.datetime(2025, 7, 8), "c"),
    ]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.xml").write_text(feed(*[item(n) for n in range(3000)]), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        frame = read_feed(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 4
        assert {r.link for r in frame.collect()} == {f"http://n/{n}" for n in range(3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_feed_dates(spark):
    cases = [
        ("Mon, 07 Jul 25 03:04:05 GMT", dt.datetime(2025, 7, 7, 3, 4, 5)),
        ("7 Jul 99 03:04", dt.datetime(1999, 7, 7, 3, 4)),
        ("Mon, 07 Jul 2025 03:04:05 GMT", dt.datetime(2025, 7, 7, 3, 4, 5)),
        ("7 July 2025 03:04 +0800", dt.datetime(2025, 7, 7, 3, 4)),
        ("Sun, 1 Dec 2024 23:59:59 +0000", dt.datetime(2024, 12, 1, 23, 59, 59)),
        ("2025-07-07T03:04:05Z", dt.datetime(2025, 7, 7, 3, 4, 5)),
        ("2025-07-07T03:04:05+08:00", dt.datetime(2025, 7, 7, 3, 4, 5)),
        ("2025-07-07 03:04:05", dt.datetime(2025, 7, 7, 3, 4, 5)),
        ("Mon, 31 Foo 2025 03:04:05 GMT", None),
        ("31 Feb 2025 03:04:05", None),
        ("yesterday", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    assert [r[0] for r in df.select(parse_feed_date(F.col("t"))).collect()] == [e for _, e in cases]


def test_attach_pages_keeps_entries_and_latest_page(spark):
    entries = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "link string")
    pages = spark.createDataFrame(
        [("a", 1, "old"), ("a", 2, "new"), ("c", 1, "other")], "url string, fetched int, content string"
    )
    got = sorted((tuple(r) for r in attach_pages(entries, pages, "fetched").collect()), key=repr)
    assert got == [("a", "new"), ("a", "new"), ("b", None), (None, None)]


def test_one_page_by_default(spark):
    entries = spark.createDataFrame([("a",)], "link string")
    pages = spark.createDataFrame([("a", "x"), ("a", "y")], "url string, content string")
    assert [tuple(r) for r in attach_pages(entries, pages).collect()] == [("a", "y")]


def test_first_ingest_on_a_new_path(spark, tmp_path):
    raw = str(tmp_path / "new")
    batch = read_feed(spark, _landed(tmp_path, item(1), item(2)))
    pages = spark.createDataFrame([("http://n/1", PAGE % 1)] * 2, schemas.PAGES)
    assert ingest_batch(batch, pages, raw) == 2
    assert sorted(r.id for r in spark.read.parquet(raw).collect()) == [1, 2]
    assert ingest_batch(batch, pages, raw) == 0


def _landed(folder, *items):
    (folder / "landed").mkdir()
    (folder / "landed" / "a.xml").write_text(feed(*items), encoding="utf-8")
    return str(folder / "landed")


def test_read_query(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert read_query(spark, "SELECT max(x) AS m FROM {t}", t=df).first().m == 2


def test_ingest_batch_parses_only_new_links(spark, tmp_path):
    raw = str(tmp_path / "raw")
    spark.createDataFrame(
        [(7, "old", "http://n/1", None, None, None, None)], schemas.NEWS_RAW_DATA
    ).write.parquet(raw)
    batch = spark.createDataFrame(
        [("t1", "http://n/1"), ("t2", "http://n/2"), ("t3", "http://n/3")], "title string, link string"
    ).withColumn("published_at", F.lit(None).cast("timestamp_ntz")).withColumn("summary", F.lit("s"))
    pages = spark.createDataFrame(
        [("http://n/1", PAGE % 1), ("http://n/2", PAGE % 2)], "url string, html string"
    )
    assert ingest_batch(batch, pages, raw) == 2
    got = {r.link: r for r in spark.read.parquet(raw).collect()}
    assert (got["http://n/2"].publisher, got["http://n/2"].content) == ("Org", "body 2")
    assert (got["http://n/3"].publisher, got["http://n/3"].content) == (None, None)
    assert len({r.id for r in got.values()}) == 3 and min(r.id for r in got.values()) == 7
    assert ingest_batch(batch, pages, raw) == 0


def test_stream_appends_unseen_links_once(spark, tmp_path):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    landing.mkdir()
    ensure_table(spark, "stream_raw", schemas.NEWS_RAW_DATA)
    pages = str(tmp_path / "pages")
    spark.createDataFrame([(f"http://n/{i}", PAGE % i) for i in range(6)], schemas.PAGES).write.parquet(pages)
    batches = []

    def run():
        query = ingest_stream(
            spark, str(landing), pages, "stream_raw", checkpoint, max_files=1,
            then=lambda batch_id, rows: batches.append(rows),
        )
        assert query.awaitTermination(120)

    def land(name, text, age):
        import os
        import time

        path = landing / name
        path.write_text(text, encoding="utf-8")
        stamp = time.time() - age
        os.utime(path, (stamp, stamp))

    land("a.xml", feed(item(1), item(2), item(2)), 60)
    land("b.xml", feed(item(2), item(3)), 30)
    run()
    assert batches == [3, 1]  # a link repeated within one batch is stored twice
    run()
    assert batches == [3, 1]
    land("c.xml", feed(item(3), item(4)), 0)
    run()
    assert batches == [3, 1, 1]
    stored = spark.table("stream_raw").collect()
    assert sorted(r.link[-1] for r in stored) == ["1", "2", "2", "3", "4"]
    assert len({r.id for r in stored}) == 5
    assert {r.content for r in stored} == {f"body {i}" for i in (1, 2, 3, 4)}
