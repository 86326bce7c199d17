"""Page parsing. Scripts are cut out by expressions. Nesting and character references are
beyond those, so the body is read in Python, over Arrow batches and once per page, up to the
end of the container.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fv

PAGE_PARTS = "struct<body: string, description: string>"
_PA_PARTS = pa.struct([("body", pa.string()), ("description", pa.string())])

# Comments and scripts in the order of the page, so that neither hides in the other.
_SCRIPTS = r"""(?is)<!--.*?(?:-->|\z)|<script(?:\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)?>.*?(?:</script\s*>|\z)"""
_JSON_LD = (
    r"""(?is)^<script\s(?:[^>"']++|"[^"]*+"|'[^']*+')*?(?-i:\btype)\s*=\s*"""
    r"""(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=[\s>]))"""
    r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>(.*?)(?:</script\s*>|\z)"""
)


def json_ld_text(html: Column) -> Column:
    """Text of the page's first linked-data script; null without one."""
    linked = F.filter(
        F.regexp_extract_all(html, F.lit(_SCRIPTS), F.lit(0)), lambda script: script.rlike(_JSON_LD)
    )
    return F.regexp_extract(F.try_element_at(linked, F.lit(1)), _JSON_LD, 1)


_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _Complete(Exception):
    """The container is read; the rest of the page is of no use."""


class _PageReader(HTMLParser):
    """Collects the paragraph text of the first container and the first meta description
    of one page."""

    def __init__(self, tag: str, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.css_class = tag, css_class
        self.open_tags: list[str] = []
        self.base: int | None = None  # depth at which the container was opened
        self.closed = False
        self.paragraphs = 0  # open <p> inside the container
        self.text: list[str] = []
        self.description: str | None = None
        self.seen_description = False

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "meta" and not self.seen_description and given.get("name") == "description":
            self.seen_description = True
            self.description = (given["content"] or "") if "content" in given else None
        if tag in _VOID:
            return
        if self.base is None:
            if tag == self.tag and (
                self.css_class is None or self.css_class in (given.get("class") or "").split()
            ):
                self.base = len(self.open_tags)
        elif not self.closed and tag == "p":
            self.paragraphs += 1
        self.open_tags.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.open_tags:
            return
        inside = self.base is not None and not self.closed
        while True:
            popped = self.open_tags.pop()
            if inside and len(self.open_tags) == self.base:
                self.closed, inside = True, False
            elif inside and popped == "p":
                self.paragraphs -= 1
            if popped == tag:
                break
        if self.closed:
            raise _Complete

    def handle_data(self, data):
        if self.base is not None and not self.closed and self.paragraphs:
            if self.open_tags[-1] not in ("script", "style"):
                self.text.append(data)

    def parts(self) -> tuple[str | None, str | None]:
        return "".join(self.text) if self.base is not None else None, self.description


def page_parts(
    html: Column, tag: str = fv.CONTAINER_TAG, css_class: str | None = fv.CONTAINER_CLASS
) -> Column:
    """`struct<body, description>` of a page; null for a null page.

    `body` is null when the container is missing and `''` when it holds no
    paragraph text. Text under several open paragraphs counts once. `description` stands
    in for a missing body and is not looked for behind the container.
    """

    @F.arrow_udf(PAGE_PARTS)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                if page is None:
                    rows.append(None)
                    continue
                reader = _PageReader(tag, css_class)
                try:
                    reader.feed(page)
                    reader.close()
                except _Complete:
                    pass
                rows.append(dict(zip(("body", "description"), reader.parts())))
            yield pa.array(rows, type=_PA_PARTS)

    return read(html)
