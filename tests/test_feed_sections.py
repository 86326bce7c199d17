"""Feed files whose sections hold what looks like entries."""

import random
from xml.etree import ElementTree

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsloom.sources import feed, read_feed
from newsloom.sources.feed import entries_of, stitched

TRICKS = [
    "<![CDATA[<item>]]>", "<![CDATA[</item>]]>", "<!-- <item> -->", "<!-- </item><item> -->", "plain", "&lt;item&gt;",
    "<![CDATA[<!-- ]]>", "<!-- <![CDATA[ -->", "<![CDATA[]] > <item ]]>", "<![CDATA[a & b &nbsp; <b>x</b>]]>",
    "<![CDATA[ <item><item></item> --> ]]>", "<!-- ]]> -->", "&amp;lt; &#60;item&#62;", "<![CDATA[" + "y" * 300 + "<item>" * 30 + "]]>",
]


def _document(rng, entries):
    def text():
        return "".join(rng.choice(TRICKS) for _ in range(rng.randrange(4)))

    items = "".join(
        f"<item><title>{i} {text()}</title><!-- {'<item>' * rng.randrange(2)} --><link>http://n/{i}</link>"
        f"<description>{text()} end</description></item>\n"
        for i in range(entries)
    )
    return f"<?xml version='1.0'?><!-- <item>head</item> --><rss><channel><title>feed</title>{items}</channel></rss>"


def _expected(text):
    out = []
    for entry in ElementTree.fromstring(text).iter("item"):
        out.append(tuple(entry.findtext(k) for k in ("title", "link", "description")))
    return sorted(out)


def _read(spark, path):
    return sorted((r.title, r.link, r.summary) for r in read_feed(spark, path).collect())


@pytest.mark.parametrize("split", ["1m", "500", "97"])
def test_sections_are_respected_wherever_files_are_cut(spark, tmp_path, split):
    rng = random.Random(7)
    texts = [_document(rng, n) for n in (60, 3, 0, 25)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.xml").write_text(text, encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = _read(spark, str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(sum(map(_expected, texts), []))
    assert all(link for _, link, _ in got)


def test_the_cases_that_lost_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><item><title>one</title><link>l1</link><description><![CDATA[see <item> here]]></description></item>"
        "<item><title>two</title><link>l2</link><description><![CDATA[ends </item> early]]></description>"
        "<pubDate>7 Jul 2025 03:04</pubDate></item><item><title>three</title><link>l3</link></item></rss>"
    )
    got = {r.link: r for r in read_feed(spark, str(tmp_path)).collect()}
    assert set(got) == {"l1", "l2", "l3"}
    assert got["l1"].summary == "see <item> here" and got["l2"].summary == "ends </item> early"
    assert got["l2"].published_at is not None


@pytest.mark.parametrize("split", ["1m", "200"])
def test_a_section_that_never_ends_costs_one_entry(spark, tmp_path, split):
    entries = "".join(f"<item><link>l{i}</link></item>" for i in range(40))
    (tmp_path / "a.xml").write_text(f"<rss>{entries}<item><title><![CDATA[open</title></item>{entries}</rss>")
    (tmp_path / "b.xml").write_text(f"<rss>{entries}</rss>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        links = [r.link for r in read_feed(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(x for x in links if x) == sorted(f"l{i}" for i in range(40) for _ in range(3))


def test_whole_pieces_are_left_alone(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<x><item>1</item><item>2</item>")
    pieces = spark.read.text(str(tmp_path), lineSep="<item")
    assert sorted(r.value for r in stitched(pieces).collect()) == ["<x>", ">1</item>", ">2</item>"]
    assert entries_of(stitched(pieces), "item").where(F.col("title").isNotNull()).count() == 0


def _after_of(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    found = frame.select("value", *[feed._after(F.col("value"), begun).alias(f"_{begun}") for begun in range(3)]).collect()
    return {r.value: (r._0, r._1, r._2) for r in found}


def test_ends_are_those_of_the_expressions(spark):
    rng = random.Random(11)
    marks = ["<![CDATA[", "]]>", "<!--", "-->", "<!", "<", "-", "]", ">", "!", "[", "xé", "中"]
    texts = {"".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(3000)}
    want = _after_of(spark, texts)
    assert {t: tuple(feed._end(t.encode(), begun) for begun in range(3)) for t in texts} == want


def test_a_feed_is_scanned_by_few_expressions(spark, tmp_path):
    """Sections are taken away once for each entry, and no expression looks for ends of pieces."""
    text = "<rss><item><title><![CDATA[a <item> b]]></title><link>l</link></item><item></item></rss>"
    (tmp_path / "a.xml").write_text(text)
    read = read_feed(spark, str(tmp_path))
    assert rows(read.select("title", "link")) == [("a <item> b", "l"), (None, None)]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(CASE WHEN Contains") + plan.count("CDATA") <= 4


def test_bytes_that_are_no_text_stay(spark, tmp_path):
    entry = b"<item><title>caf\xe9 %s</title><link>l</link></item>"
    (tmp_path / "a.xml").write_bytes(b"<rss>" + entry % b"x" + entry % b"<![CDATA[<item>]]>" + b"</rss>")
    found = read_feed(spark, str(tmp_path)).select(F.hex(F.col("title").cast("binary")).alias("h")).collect()
    assert sorted(bytes.fromhex(r.h)[:3] for r in found) == [b"caf", b"caf"]
