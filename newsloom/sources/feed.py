"""Landed feed files and landed pages.

Feed files are cut where entries begin, so that one file may be read by many tasks. What looks
like the begin of an entry may stand inside a marked section or a comment: pieces that begin
there are put together again with the piece before them. Whether a piece ends inside follows
from its own marks and from how it began, so that each task goes through its part of a file
once; only how a part begins has to be known from the parts before it, and these are as many
as a file has splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_feed_date

# Elements of RSS and of Atom that hold the same thing, the one to prefer first.
_TITLE = ("title",)
_DATE = ("pubDate", "dc:date", "published", "updated")
_SUMMARY = ("description", "summary", "content")

# A marked section or a comment.
_SECTION = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->"

_XML_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
# Names of characters in HTML.
_NAMES = {name: chr(code) for name, code in name2codepoint.items()} | _XML_NAMES
_PIECE = r"&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"


def decode_references(text: Column) -> Column:
    """Character references, by name or number, as characters; unknown ones stay as written."""
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])

    def decoded(piece: Column) -> Column:
        code = F.when(
            F.lower(F.left(piece, F.lit(3))) == "&#x",
            F.conv(F.regexp_extract(piece, "(?i)&#x([0-9a-f]+);", 1), 16, 10),
        ).otherwise(F.regexp_extract(piece, "&#([0-9]+);", 1)).try_cast("int")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        numbered = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code)), 8, "0")), "UTF-32")
        plain = F.when(~F.startswith(piece, F.lit("&")), piece)  # the map is searched for rare names only
        for name, mark in _XML_NAMES.items():
            plain = plain.when(piece == f"&{name};", mark)
        return plain.when(F.startswith(piece, F.lit("&#")), F.coalesce(numbered, piece)).when(
            F.startswith(piece, F.lit("&")),
            F.coalesce(F.try_element_at(names, F.substring_index(F.substring(piece, 2, 40), ";", 1)), piece),
        ).otherwise(piece)

    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), decoded)
    plain = text
    for name in ("lt", "gt", "quot", "apos", "amp"):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(_XML_NAMES[name]))
    return (
        F.when(~F.contains(text, F.lit("&")), text)
        .when(~text.rlike("&(?!(?:lt|gt|quot|apos|amp);)"), plain)
        .otherwise(F.array_join(pieces, ""))
    )


def _body(entry: Column, elements: tuple[str, ...]) -> Column:
    """What stands between the tags of the first of some elements that is there and not empty."""
    return F.coalesce(
        *[
            F.nullif(
                F.regexp_extract(entry, rf"(?s)<{e}(?:\s[^>]*)?(?<!/)>(.*?)</{e}\s*>", 1), F.lit("")
            )
            for e in elements
        ]
    )


def _without_sections(value: Column) -> Column:
    """Marked sections as text with references, comments gone: what is left has tags only
    where there are elements."""
    parts = F.regexp_extract_all(value, F.lit(rf"{_SECTION}|[^<]+|<"), F.lit(0))

    def as_text(part: Column) -> Column:
        inner = F.substring(part, F.lit(10), F.length(part) - 12)
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(mark), F.lit(name))
        return F.when(part.startswith("<![CDATA["), inner).when(part.startswith("<!--"), "").otherwise(part)

    return F.when(F.contains(value, F.lit("<!")), F.array_join(F.transform(parts, as_text), "")).otherwise(value)


def _address(entry: Column) -> Column:
    """The address in the attribute of the first link that is none to something beside the
    article."""
    tags = F.regexp_extract_all(entry, F.lit(r"<link\s[^>]*>"), F.lit(0))
    main = F.filter(tags, lambda t: ~t.rlike(r"\srel\s*=") | t.rlike(r"""\srel\s*=\s*["']?alternate\b"""))
    return F.nullif(
        F.regexp_extract(F.try_element_at(main, F.lit(1)), r"""\shref\s*=\s*(["'])(.*?)\1""", 2), F.lit("")
    )


def entries_of(pieces: DataFrame, row_tag: str) -> DataFrame:
    """One row per entry from texts cut where `<row_tag` stands. Each entry is read by itself,
    so that a broken one leaves its neighbours alone; one that is cut off gives no row."""
    whole = rf"(?s)^(?:\s[^>]*)?>(.*?)</{row_tag}\s*>"
    # exploded, so that no filter repeats the work of taking sections away and finding the end
    found = F.regexp_extract_all(_without_sections(F.col("value")), F.lit(whole), F.lit(1))
    entries = pieces.select(F.explode(found).alias("entry"))
    e = F.col("entry")
    bodies = entries.select(
        _body(e, _TITLE).alias("title"),
        F.coalesce(_body(e, ("link",)), _address(e)).alias("link"),
        _body(e, _DATE).alias("date"),
        _body(e, _SUMMARY).alias("summary"),
    )
    return bodies.select(
        decode_references(F.col("title")).alias("title"),
        F.trim(decode_references(F.col("link"))).alias("link"),
        parse_feed_date(decode_references(F.col("date"))).alias("published_at"),
        decode_references(F.col("summary")).alias("summary"),
    )


# Where a text may end: among elements, in a marked section, in a comment.
_ELEMENTS, _MARKED, _COMMENT = range(3)
_ENDS = {_MARKED: "]]>", _COMMENT: "-->"}
_BEGIN_BYTES = (b"<![CDATA[", b"<!--")
_END_BYTES = {begun: end.encode() for begun, end in _ENDS.items()}


def _after(value: Column, begun: int) -> Column:
    """How a text ends that begins in one of the three ways."""
    rest = value
    if begun in _ENDS:
        end = F.locate(_ENDS[begun], value)
        rest = F.when(end > 0, F.substring(value, end + 3, F.length(value)))
    opened = F.regexp_extract(F.regexp_replace(rest, _SECTION, " "), r"<!\[CDATA\[|<!--", 0)
    return (
        F.when(rest.isNull(), begun)
        .when(~F.contains(rest, F.lit("<!")), _ELEMENTS)
        .when(opened == "<![CDATA[", _MARKED)
        .when(opened == "<!--", _COMMENT)
        .otherwise(_ELEMENTS)
    )


def _end(text: bytes, begun: int) -> int:
    """`_after` of one text, looking from mark to mark. Bytes, since feeds need not be valid UTF-8."""
    at = 0
    while True:
        if begun:
            end = text.find(_END_BYTES[begun], at)
            if end < 0:
                return begun
            at = end + 3
        at = text.find(b"<!", at)
        while at >= 0 and not text.startswith(_BEGIN_BYTES, at):
            at = text.find(b"<!", at + 2)
        if at < 0:
            return _ELEMENTS
        begun = _MARKED if text.startswith(_BEGIN_BYTES[0], at) else _COMMENT
        at += len(_BEGIN_BYTES[begun - 1])


def _with_places(texts: DataFrame) -> DataFrame:
    """Pieces with their file and split."""
    return texts.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("in_splits"),
    )


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple[str, int]]]:
    """Text of each piece, with its file and split; pieces of one split share the tuple."""
    files, splits = batch.column("file").dictionary_encode(), batch.column("split").to_pylist()
    names, made = files.dictionary.to_pylist(), {}
    places = (made.get(k) or made.setdefault(k, (names[k[0]], k[1])) for k in zip(files.indices.to_pylist(), splits))
    return zip(batch.column("value").cast(pa.binary()).to_pylist(), places)


def _then(ends: int, begun: int) -> int:
    return ends // 3**begun % 3


def _begun_inside(pieces: DataFrame) -> dict[tuple[str, int], int]:
    """The splits that begin inside a section, and in which. Each split sends one number; what is
    kept is one entry for a split that begins inside."""

    def ends_of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, [0, 1, 2]
        for batch in batches:
            done = []
            for value, at in _pieces(batch):
                if at != place:
                    if place:
                        done.append((*place, total))
                    place, total = at, [0, 1, 2]
                ends = {begun: _end(value, begun) for begun in set(total)}
                total = [ends[begun] for begun in total]
            yield _split_rows(done)
        yield _split_rows([(*place, total)] if place else [])

    def _split_rows(rows: list) -> pa.RecordBatch:
        files, splits, totals = zip(*rows) if rows else ((), (), ())
        numbers = [t[0] + 3 * t[1] + 9 * t[2] for t in totals]
        return pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(splits, pa.int64()), pa.array(numbers, pa.int32())],
            ["file", "split", "ends"],
        )

    def begins(table: pa.Table) -> pa.Table:
        begun, found = _ELEMENTS, []
        for row in table.sort_by("split").to_pylist():
            if begun:
                found.append({"file": row["file"], "split": row["split"], "begun": begun})
            begun = _then(row["ends"], begun)
        return pa.Table.from_pylist(
            found, pa.schema([("file", pa.string()), ("split", pa.int64()), ("begun", pa.int32())])
        )

    split = pieces.where("in_splits").select("value", "file", "split")
    split = split.mapInArrow(ends_of_splits, "file string, split bigint, ends int")
    rows = split.groupBy("file").applyInArrow(begins, "file string, split bigint, begun int").collect()
    return {(r["file"], r["split"]): r["begun"] for r in rows}


def _joined(pieces: DataFrame, row_tag: str, begun: dict[tuple[str, int], int]) -> DataFrame:
    """Pieces of each split put together where they begin inside: value, file, split, and `kind`:
    whole, the end of what an earlier split began, or begun and not ended in this split."""

    tag = f"<{row_tag}".encode()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, held, kind = None, _ELEMENTS, [], _WHOLE
        for batch in batches:
            out = []
            for value, at in _pieces(batch):
                if at != place:
                    if held:
                        out.append((tag.join(held), *place, kind or _BEGUN))
                    place, held = at, []
                    state = begun.get(place, _ELEMENTS)
                    kind = _ENDED if state else _WHOLE
                    if state:
                        held = [b""]  # the tag at which the piece was cut
                held.append(value)
                state = _end(value, state)
                if not state:
                    out.append((tag.join(held), *place, kind))
                    held, kind = [], _WHOLE
            yield made(*(zip(*out) if out else ((), (), (), ())))
        if held:
            yield made([tag.join(held)], [place[0]], [place[1]], [kind or _BEGUN])

    def made(values, files, splits, kinds) -> pa.RecordBatch:
        texts = pa.array(values, pa.binary()).view(pa.string())
        places = pa.array(files, pa.string()), pa.array(splits, pa.int64())
        return pa.RecordBatch.from_arrays([texts, *places, pa.array(kinds, pa.int32())], ["value", "file", "split", "kind"])

    schema = "value string, file string, split bigint, kind int"
    return pieces.select("value", "file", "split").mapInArrow(join, schema)


_WHOLE, _ENDED, _BEGUN = range(3)


def stitched(texts: DataFrame, row_tag: str = "item") -> DataFrame:
    """`value`: the texts of feed files cut at `<row_tag`, with cuts inside marked sections and
    comments undone. A section that never ends is none: its file is cut as if it were not there."""
    pieces = _with_places(texts)
    begun = _begun_inside(pieces)
    joined = _joined(pieces, row_tag, begun)

    def cut_again(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.split("value", f"<{row_tag}")).alias("value"))

    if not begun:
        # what is begun here ends nowhere
        again = F.when(F.col("kind") == _WHOLE, F.array("value")).otherwise(F.split("value", f"<{row_tag}"))
        return joined.select(F.explode(again).alias("value"))
    # few rows: one or two for a split that begins inside
    over = joined.where(F.col("kind") != _WHOLE)
    order = Window.partitionBy("file").orderBy("split", "kind")
    run = F.sum((F.col("kind") == _BEGUN).cast("int")).over(order)
    texts_of = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "kind", "value"))), lambda x: x["value"]), "")
    runs = over.withColumn("run", run).groupBy("file", "run").agg(texts_of.alias("value"))
    # a run that begins in its file's last section may end nowhere, too
    open_end = _after(F.col("value"), _ELEMENTS) != _ELEMENTS
    return (
        joined.where(F.col("kind") == _WHOLE)
        .select("value")
        .unionByName(runs.where(~open_end).select("value"))
        .unionByName(cut_again(runs.where(open_end)))
    )


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of every feed file under `path`; a missing element is null.

    `row_tag` is `item` for RSS and `entry` for Atom. Files are split where entries begin,
    so that one file may be read by many tasks.
    """
    return entries_of(stitched(spark.read.text(path, lineSep=f"<{row_tag}"), row_tag), row_tag)


def read_feed_stream(
    spark: SparkSession, path: str, row_tag: str = "item", max_files: int | None = None
) -> DataFrame:
    """`read_feed` over files as they land, at most `max_files` per micro-batch. Each file is read
    whole, as feeds land in small files; a large dump is better read by `read_feed`."""
    reader = spark.readStream.option("wholetext", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    cut = F.explode(F.split(_without_sections(F.col("value")), f"<{row_tag}"))
    return entries_of(reader.text(path).select(cut.alias("value")), row_tag)


def attach_pages(feed: DataFrame, pages: DataFrame, order: str | None = None) -> DataFrame:
    """Give every feed entry the columns of its page; entries without one get nulls.

    `pages` is keyed by `url`. Hand it extracted columns rather than the HTML, so only
    those are shuffled. Where a page landed more than once, one is kept: that with the
    greatest value of the column `order`, if one is named, then the greatest of the rest.
    """
    rest = [c for c in pages.columns if c not in ("url", order)]
    place = [order] if order is not None else []
    if place or rest:
        latest = F.max(F.struct(*place, *rest)).alias("_page")
        pages = pages.groupBy("url").agg(latest).select(
            "url", *[F.col(f"_page.`{c}`").alias(c) for c in rest]
        )
    # The second key keeps the join in a stage behind the one that picks pages, where a link
    # that very many entries share can be split.
    pages = pages.withColumn("_hash", F.xxhash64("url"))
    same = (F.col("link") == F.col("url")) & (F.xxhash64("link") == F.col("_hash"))
    return feed.join(pages, same, "left").select(*feed.columns, *rest)
