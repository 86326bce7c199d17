"""Publisher and body text of landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions.html import json_ld_text, page_parts

_PARTY = "struct<`@type`: string, name: string>"
_LINKED_DATA = f"creator {_PARTY}, provider {_PARTY}"


def first_json_ld(html: Column) -> Column:
    """JSON text of the page's first linked-data script."""
    return json_ld_text(html)


def resolve_publisher(json_ld: Column) -> Column:
    """Name of the creator if it is an organization, else of the provider by the same
    test, else null. Anything but a JSON object has no publisher."""
    data = F.from_json(F.when(F.ltrim(json_ld).startswith("{"), json_ld), _LINKED_DATA)

    def organization(party: Column) -> Column:
        return F.when(party["@type"] == "Organization", party["name"])

    return F.coalesce(organization(data["creator"]), organization(data["provider"]))


def article_body(parts: Column) -> Column:
    """Paragraph text of the container: null if it is missing, `''` if it is empty."""
    return parts["body"]


def body_fallback(parts: Column) -> Column:
    """The body, or the meta description of a page without the container."""
    return F.coalesce(article_body(parts), parts["description"])


def extract_pages(
    pages: DataFrame,
    tag: str = fv.CONTAINER_TAG,
    css_class: str | None = fv.CONTAINER_CLASS,
    html: str = "html",
) -> DataFrame:
    """Replace the HTML column by `publisher` and `content`."""
    rest = [c for c in pages.columns if c != html]
    parsed = pages.select(
        *rest,
        first_json_ld(F.col(html)).alias("_json_ld"),
        page_parts(F.col(html), tag, css_class).alias("_parts"),
    )
    parts = F.col("_parts")
    return parsed.select(
        *rest,
        resolve_publisher(F.col("_json_ld")).alias("publisher"),
        body_fallback(parts).alias("content"),
    )
