import pytest
from pyspark.sql import functions as F

from newsloom.functions.html import page_parts
from newsloom.operators.extract import extract_pages, resolve_publisher


def ld(body):
    return f'<html><head><script type="application/ld+json">{body}</script></head><body>'


ATOMS = '<div class="caas atoms">{}</div>'

PAGES = [
    ("creator", ld('{"creator":{"@type":"Organization","name":"C"},"provider":{"@type":"Organization","name":"P"}}')
     + ATOMS.format("<p>a</p><p>b</p>"), "C", "ab"),
    ("provider", ld('{"creator":{"@type":"Person","name":"C"},"provider":{"@type":"Organization","name":"P"}}')
     + ATOMS.format("<p>x &amp; y&nbsp;z</p>"), "P", "x & y\xa0z"),
    ("creator is text", ld('{"creator":"C","provider":{"@type":"Organization","name":"P"}}'), "P", None),
    ("nameless creator", ld('{"creator":{"@type":"Organization"},"provider":{"@type":"Organization","name":"P"}}'), "P", None),
    ("nobody", ld('{"creator":{"@type":"Person","name":"C"}}'), None, None),
    ("list", ld('[{"creator":{"@type":"Organization","name":"C"}}]'), None, None),
    ("broken", ld('{"creator":') + ATOMS.format("<p>a</p>"), None, "a"),
    ("second script only counts if first", ld("{}") + ld('{"creator":{"@type":"Organization","name":"C"}}'), None, None),
    ("other script first", '<script>var x = "</p>";</script>' + ld('{"creator":{"@type":"Organization","name":"C"}}'), "C", None),
    ("description", '<meta name="description" content="D &lt;1&gt;"><p>out</p>', None, "D <1>"),
    ("empty description", '<meta name="description" content="">', None, ""),
    ("description without content", '<meta name="description">', None, None),
    ("empty container", '<meta name="description" content="D">' + ATOMS.format(""), None, ""),
    ("text outside paragraphs", ATOMS.format("lost<p>kept</p>lost"), None, "kept"),
    ("nested divs", ATOMS.format("<div><p>a</p></div><div>x<div><p>b</p></div></div><p>c</p>") + "<p>out</p>", None, "abc"),
    ("unclosed paragraphs once", ATOMS.format("<p>a<p>b</p>c") + "<p>out</p>", None, "abc"),
    ("unclosed in a nested div", ATOMS.format("<div><p>a</div>lost<p>b</p>"), None, "ab"),
    ("inline tags", ATOMS.format("<p>a<b>b</b><br>c<img src=x>d</p>"), None, "abcd"),
    ("script in paragraph", ATOMS.format("<p>a<script>'</p>'</script>b</p>"), None, "ab"),
    ("comment", ATOMS.format("<p>a<!-- </p> -->b</p>"), None, "ab"),
    ("only the first container", ATOMS.format("<p>a</p>") + ATOMS.format("<p>b</p>"), None, "a"),
    ("class is a word", '<div class="atoms2"><p>a</p></div>', None, None),
    ("stray end tags", ATOMS.format("</p><p>a</p></span></p>") , None, "a"),
    ("never closed", '<div class="atoms"><p>a', None, "a"),
    ("attributes with marks", ATOMS.format("<p title='</p>'>a</p>"), None, "a"),
]


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(n, h) for n, h, _, _ in PAGES] + [("null", None)], "url string, html string")
    return {r.url: (r.publisher, r.content) for r in extract_pages(df).collect()}


@pytest.mark.parametrize("name, publisher, content", [(n, p, c) for n, _, p, c in PAGES])
def test_page(extracted, name, publisher, content):
    assert extracted[name] == (publisher, content)


def test_missing_page(extracted):
    assert extracted["null"] == (None, None)


def test_other_container(spark):
    df = spark.createDataFrame([("<article><p>a</p></article>",)], "html string")
    assert df.select(page_parts(F.col("html"), "article", None)["body"]).first()[0] == "a"


def test_publisher_of_plain_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("text",), ('"text"',)], "j string")
    assert [r[0] for r in df.select(resolve_publisher(F.col("j"))).collect()] == [None] * 4
