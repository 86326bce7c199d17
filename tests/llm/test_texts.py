"""Packing, secrets and pages against brute force and exact round trips."""

import random
import re
import string
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from newsloom.llm import html_text, packing, secrets, tokens
from newsloom.llm.queries import TOKENIZER


def test_encoder_equals_the_tokenizer():
    texts = ["It's <|endoftext|> DON'T!! a\x1cb İstanbul ΣΑΣ café ﬁne １２3 'tis ’s ½ _a_ a_b", "", None, "  ", "É́ ́a ß ẞ Å x\x85y z"]
    with open(TOKENIZER, encoding="utf-8") as file:
        description = file.read()
    tokenizer = Tokenizer.from_str(description)
    ids, bounds, _ = tokens.WordEncoder(description).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("part, shard", [(8_000_000, 1_000_000), (3000, 1500)])
def test_packing_round_trip(documents, part, shard):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(documents, TOKENIZER, part_tokens=part, shard_tokens=shard, with_ids=True).collect()
    windows = {}
    for r in pieces:
        assert len(r.ids) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    expected = sorted((r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in documents.collect() if r.doc_id)
    whole = {}
    for r in sorted(pieces, key=lambda r: r.start):
        if r.doc_id:
            whole.setdefault(r.doc_id, []).extend(r.ids)
    assert sorted(whole.items()) == expected
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_only_the_last_window_is_not_full(documents):
    total = {}
    for r in packing.pack(documents, TOKENIZER).collect():
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert sorted(total.values())[1:] == [2048] * (len(total) - 1)


def test_sequences_are_padded(documents):
    for r in packing.sequences(packing.pack(documents, TOKENIZER, with_ids=True)).collect():
        assert len(r.ids) == 2048


def test_neighbours_by_bm25():
    rng = random.Random(0)
    docs = [np.array([rng.randrange(50) + 50 * (i % 4) for _ in range(80)], np.uint32) for i in range(40)]
    index = packing.Index(docs, query_terms=1000)
    used = np.zeros(40, bool)
    used[[0, 4]] = True
    df = {t: sum(t in set(d.tolist()) for d in docs) for t in range(200)}

    def score(q, d):
        d = d.tolist()
        return sum(
            np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2)
            for t in set(q.tolist()) & set(d)
        )

    expected = sorted((i for i in range(40) if i % 4 == 0 and not used[i]), key=lambda i: -score(docs[0], docs[i]))
    assert index.neighbours(0, used).tolist() == expected


PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def test_base_spans():
    rng = random.Random(2)
    bits = ["token", "Api_KEY", "PassWord", "passwd", "secret", "apikey", "=", ": ", '"', "'", " ", "AKIA", "abc123", "0f" * 13, "ABCDEFGH1234", "/", ".", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        expected = []
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, text, re.ASCII):
                value = m[2] if kind == "assign" else m[0]
                if len(value) >= LEAST[kind]:
                    expected.append((kind, *m.span(), value))
        expected.sort(key=lambda s: (s[1], list(PATTERNS).index(s[0])))
        assert secrets.base_spans(text) == expected


def _credential(rng):
    return "sk" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30))


def test_formats_find_unmarked_credentials(spark):
    rng = random.Random(4)
    rows = [(i, f"some words token = \"{_credential(rng)}\" and more") for i in range(200)]
    rows += [(200 + i, f"call 2024-01-{i % 28 + 1:02d}T10:00:00 mail user.{i}@host-number.example.com or 4111.1111.1111.{i:04d}") for i in range(200)]
    bare = {400 + i: f"lost {_credential(rng)} here" for i in range(50)}
    rows += list(bare.items())
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_assign == 1 for i in range(200))
    found = [i for i in bare if "format:5:37" in got[i].spans]
    assert len(found) >= 45
    assert not any("format" in got[i].spans for i in range(400))


def test_parts_of_runs_few_labels_and_short_values(spark):
    rng = random.Random(8)
    short = lambda rng: "".join(rng.choice("0123456789abcdef") for _ in range(12))
    for labels, made, least in ((200, _credential, 45), (5, _credential, 30), (200, short, 40)):
        rows = [(i, f'some words token = "{made(rng)}" and more') for i in range(labels)]
        rows += [(1000 + i, f"see section-{i % 9}.html of report_{i % 13}.pdf, released 2024-01-{i % 28 + 1:02d}") for i in range(200)]
        bare, rests = {}, ["private_key={}", "host/path/{}", "sig={}", "a=1/b={}", "{}"]
        for i in range(50):
            value = made(rng)
            text = "seen " + rests[i % len(rests)].format(value) + " there"
            bare[2000 + i] = f"format:{text.index(value)}:{text.index(value) + len(value)}"
            rows.append((2000 + i, text))
        got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(span in got[i] for i, span in bare.items()) >= least
        assert sum("format" in got[i] for i in got if i < 2000) <= 10


def test_runs_and_parts_of_long_texts():
    assert secrets.runs("a1b2c3 abcdef 123456 x1", []) == [(0, 6)]
    assert secrets.runs("a1b2c3 abcdef", [], digit=False) == [(0, 6), (7, 13)]
    assert secrets.runs("a1b2c3 d4e5f6", [(2, 4)]) == [(7, 13)]
    assert {"key=abcdef=="[a:b] for a, b in secrets.parts("key=abcdef==")} == {"key=abcdef==", "abcdef==", "abcdef"}
    rng = random.Random(9)
    block = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(5000))
    values = [block[i:] + block[:i] for i in range(500)]
    start = time.process_time()
    formats = secrets.Formats({"assign": values[:250]}, values[250:])
    formats.inside("x=" + block * 200)
    assert time.process_time() - start < 20


def test_automaton_merges_and_ranks():
    rng = random.Random(6)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(400)]
    automaton = secrets.Automaton(values[:300])
    assert sum(automaton.score(v) > automaton.score("ordinary-words-here.and-there") for v in values[300:]) == 100


PAGES = {
    "<p>One<p>Two": "One\n\nTwo",
    "<div>a</div><div>b</div>": "a\nb",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>x<li>y<ul><li>z</ul></ul>": "- x\n- y\n  - z",
    "<ol start=3><li>x</li><li>y</li></ol>": "3. x\n4. y",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><tr><th colspan=2>head<tr><td>a<td>b</table>": "head\na  b",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<script>var a='</p>';</script>x<style>p{}</style>": "x",
    "<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p>yes": "yes",
    "<pre>a\n  b</pre>": "a\n  b",
    "a &amp; b&nbsp;c &#39;d&#39;": "a & b\xa0c 'd'",
    "<b>bo</b>ld <i> x </i>": "bold x",
    "<head><title>t</title></head><body>b</body>": "b",
    "5 < 6 <!-- no --> ok": "5 < 6 ok",
    "<p title='a > b'>q</p>": "q",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "</p></div>stray</b>": "stray",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_text.page_text(page) == PAGES[page]


def test_depth_has_no_limit():
    assert html_text.page_text("<div>" * 20_000 + "x") == "x"
    assert html_text.page_text("<table><tr><td>" * 3000 + "x") == "x"


HARD = {
    "tags that never end": "<a " * 350_000,
    "many open tags": "<p>" * 100_000 + "x",
    "end tags of nothing": "<div>" * 20_000 + "</b>" * 100_000,
    "a script that never ends": "<script>" + "</script " * 100_000,
    "one wide cell": "<table><tr><td>" + "w" * 200_000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>",
    "a wide row over short ones": "<table><tr>" + "<td>abc" * 10_000 + "<tr><td colspan=999>x<td>y" * 3000 + "</table>",
    "spans": "<table>" + "<tr><td colspan=1000 rowspan=1000>a<td colspan=1000 rowspan=1000>b" * 300 + "</table>",
    "lists in lists": "<ul><li>x" * 10_000,
    "tables in tables": "<table><tr><td>" + ("a" * 50 + "<td><table><tr><td>") * 500 + "x<br>" * 3000,
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_little_time_and_room(name):
    start = time.process_time()
    text = html_text.page_text(HARD[name])
    assert time.process_time() - start < 6
    assert len(text) < 25 * len(HARD[name])
    assert text.count("w") in (0, 200_000)


def test_details_long_cells_and_unfinished_tags():
    assert html_text.page_text("<details><summary>s</summary>no<p>no</details>x") == "s\nx"
    assert html_text.page_text("<details open><summary>s</summary>yes</details>x") == "s\nyes\nx"
    assert html_text.page_text("a <b") == html_text.page_text("a<!-- x > y") == "a"
    assert html_text.page_text("1 > 0 < 2") == "1 > 0 < 2"
    long = "w" * 100
    assert html_text.page_text(f"<table><tr><td>{long}<td>b<tr><td>aa<td>c</table>") == f"{long}  b\naa  c"


def test_all_visible_words_of_the_pages_come_out(spark):
    """The words of every shown text, in order, counted by a plain parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.words = [], []

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "head"):
                self.hidden.append(tag)

        def handle_endtag(self, tag):
            if self.hidden and tag == self.hidden[-1]:
                self.hidden.pop()

        def handle_data(self, data):
            if not self.hidden:
                self.words.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        strip = lambda t: re.sub(r"\s+|- ", "", t)
        assert strip(html_text.page_text(r.html)) == strip("".join(plain.words))


DRAWN = {
    "<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>tex</annotation></semantics></math> hold.</p>": "Let x=2 hold.",
    "<div>See<svg><title>T</title><desc>d</desc><defs><text>no</text></defs><path d='M0'/><text>North</text>"
    "<text>South</text><script>s()</script></svg>after</div>": "See\nNorth\nSouth\nafter",
    "<svg><title/><desc/><defs/><text>a</text></svg>b": "a\nb",
    "<svg><foreignObject><p>Html<br/>two</p></foreignObject></svg>": "Html\ntwo",
    "Size <select><option>Small<option selected>Large<optgroup label=Odd><option>XL</select> ok": "Size\nSmall\nLarge\nOdd\nXL\nok",
    "<input list=d><datalist id=d><option>no</datalist>x": "x",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>end": "yes\nend",
    "<div style='display:none'><b style='visibility:visible'>no</b></div>x": "x",
    "<div hidden><b style='visibility:visible'>no</b></div>x": "x",
    "<ol><li>a<li style='visibility:hidden'>no<li>c</ol>": "1. a\n3. c",
    "<table><tr><td>a<td style='visibility:hidden'>no<td>c</table>": "a    c",
}


@pytest.mark.parametrize("page", DRAWN)
def test_drawn_text_and_inherited_visibility(page):
    assert html_text.page_text(page) == DRAWN[page]
