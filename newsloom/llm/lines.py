"""Line dedup by a log-template tree.

Lines are parsed to a fixed depth: by their number of tokens, then by their first tokens,
in which every token with a digit counts as the field `<*>`. That is the leaf. Each leaf's
most frequent line is a template. A line of the leaf that agrees with it in most constant
tokens belongs to it, and the places where any of them differ become fields too. Of the
lines left over, tokens that stand nowhere else at their place of the leaf become fields:
lines with the same constant tokens are one template, so that a leaf holds as many as it
needs. Short lines, and those with hardly any constant token, are templates by exact text.
A template that occurs in several documents is recurring: its first line stays, all others
are dropped.

What shuffles for each line is its place and two hashes. Only lines of leaves that hold
more than one text and several documents are compared as text, each text once; a Bloom
filter of their places, of bounded size, finds them in a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import bloom
from newsloom.llm.common import column, free_name, join_apart
from newsloom.session import materialize

DEPTH = 3
#: Lines of fewer tokens, or of fewer constant ones, are compared as they are.
MIN_TOKENS = 5
MIN_CONSTANT = 3
MIN_DOCS = 2
#: Share of the constant tokens that lines of a template have in common, and of those behind
#: the leading ones.
AGREE, AGREE_BEHIND = 0.7, 0.5
FIELD = "<*>"

_BLANK = r"[\x20\x09-\x0D]"
_DIGIT_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def tidy(line: Column) -> Column:
    """The line with one blank between tokens. Most lines are tidy, which plain searches tell."""
    untidy = F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ")
    for blank in "\t\v\f\r":
        untidy = untidy | F.contains(line, F.lit(blank))
    return F.when(untidy, F.trim(F.regexp_replace(line, f"{_BLANK}+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """The line with a field for each token with a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _DIGIT_TOKEN, FIELD)).otherwise(line)


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = column(text_col)
    return docs.select(
        column(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.posexplode(F.split(text, "\n")).alias("line_no", "line"),
    )


def _parsed(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    tokens = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    line = F.col("line")
    digits = F.when(line.rlike("[0-9]"), F.regexp_count(line, F.lit(_DIGIT_TOKEN))).otherwise(0)
    exact = (F.col("tokens") < min_tokens) | (F.col("tokens") - F.col("digits") < MIN_CONSTANT)
    return (
        _cut(docs, id_col, text_col)
        .withColumn("line", tidy(line))
        .filter(line != "")
        .withColumn("tokens", tokens)
        .withColumn("digits", digits)
        .withColumn("exact", exact)
        .withColumn("line", F.when(F.col("exact") | (F.col("digits") == 0), line).otherwise(masked(line)))
        .select(
            "doc_id",
            "text_key",
            "line_no",
            F.when(F.col("exact"), F.xxhash64("line"))
            .otherwise(F.xxhash64("tokens", F.substring_index("line", " ", depth)))
            .alias("leaf"),
            F.xxhash64("line", "exact").alias("line_key"),
        )
    )


def _signatures(texts: DataFrame, depth: int, min_docs: int, agree: float) -> DataFrame:
    """leaf, line_key, signature of the lines whose constant tokens make a template: those
    that stand `min_docs` times or more at their place of the leaf."""
    place = F.xxhash64("leaf", "at", "token")
    tokens = (
        texts.select("leaf", "line_key", "n", F.posexplode(F.split("line", " ")).alias("at", "token"))
        .filter(F.col("token") != FIELD)
        .withColumn("place", place)
    )
    constant = tokens.groupBy("place").agg(F.sum("n").alias("often")).filter(F.col("often") >= min_docs).select("place")
    behind = F.count_if(F.col("at") >= depth)
    all_tokens = tokens.groupBy("leaf", "line_key").agg(F.count(F.lit(1)).alias("all"), behind.alias("all_behind"))
    kept = (
        join_apart(tokens, constant, "place")
        .groupBy("leaf", "line_key")
        .agg(
            F.xxhash64(F.sort_array(F.collect_list(F.struct("at", "token")))).alias("signature"),
            F.count(F.lit(1)).alias("kept"),
            behind.alias("kept_behind"),
        )
    )
    return (
        kept.join(all_tokens, ["leaf", "line_key"])
        .filter((F.col("kept") >= MIN_CONSTANT) & (F.col("kept") >= agree * F.col("all")))
        .filter(F.col("kept_behind") >= AGREE_BEHIND * F.col("all_behind"))
        .select("leaf", "line_key", "signature")
    )


def line_templates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_tokens: int = MIN_TOKENS,
    min_docs: int = MIN_DOCS,
    agree: float = AGREE,
) -> tuple[DataFrame, DataFrame]:
    """(lines, templates). `lines`: doc_id, text_key, line_no, template of every line with a
    token. `templates`: template, n_docs, first, for recurring ones. Lines of less than
    `min_tokens` tokens recur by exact text, blanks aside.

    Rows that repeat id and text are one document. Null texts have no lines; blank lines
    have no template. Null ids are ids and come first.
    """
    lines = materialize(_parsed(docs, id_col, text_col, depth, min_tokens), "lines")
    document = ["doc_id", "text_key"]
    leaves = (
        lines.groupBy("leaf", *document)
        .agg(F.min("line_key").alias("low"), F.max("line_key").alias("high"))
        .groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter((F.col("n_docs") >= min_docs) & (F.col("low") < F.col("high")))
        .select("leaf")
    )
    # one place at which each text of these leaves can be read
    place = F.xxhash64("text_key", "line_no")
    places = materialize(
        lines.groupBy("leaf", "line_key")  # before the join, so that a very common line is one row
        .agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
        .join(leaves, "leaf", "left_semi"),
        "places",
    )
    bits = bloom.bits_for(places.count())
    words = materialize(bloom.filter_of(places, "place", bits), "bloom")
    texts = materialize(
        bloom.tested(_cut(docs, id_col, text_col).withColumn("place", place), "place", words, bits, "maybe")
        .filter("maybe")
        .select("place", masked(tidy(F.col("line"))).alias("line"))
        .join(places, "place")
        .groupBy("leaf", "line_key")
        .agg(F.first("line").alias("line"), F.first("n").alias("n")),
        "texts",
    )
    seeds = texts.groupBy("leaf").agg(F.max_by("line", F.struct("n", "line")).alias("seed"))
    pairs = F.arrays_zip(F.split("line", " ").alias("a"), F.split("seed", " ").alias("b"))
    places = F.filter(pairs, lambda p: (p["a"] != FIELD) | (p["b"] != FIELD))
    behind = F.filter(
        F.slice(pairs, depth + 1, F.greatest(F.size(pairs) - depth, F.lit(0))),
        lambda p: (p["a"] != FIELD) | (p["b"] != FIELD),
    )
    same = lambda found: F.size(F.filter(found, lambda p: p["a"] == p["b"]))
    judged = materialize(
        join_apart(texts, seeds, "leaf").select(
            "leaf",
            "line_key",
            "line",
            "n",
            (
                (same(places) >= MIN_CONSTANT)
                & (same(places) >= agree * F.size(places))
                & (same(behind) >= AGREE_BEHIND * F.size(behind))
            ).alias("joins"),
        ),
        "judged",
    )
    rest = _signatures(judged.filter(~F.col("joins")), depth, min_docs, agree)
    joined = materialize(
        judged.filter("joins")
        .select("leaf", "line_key", F.xxhash64("leaf", F.lit("leaf")).alias("group"))
        .unionAll(rest.select("leaf", "line_key", F.xxhash64("leaf", "signature", F.lit("rest")).alias("group"))),
        "joined",
    )
    template = F.coalesce("group", F.xxhash64("leaf", "line_key"))
    named = materialize(
        lines.join(joined, ["leaf", "line_key"], "left").select(
            *document, "line_no", template.alias("template")
        ),
        "templates",
    )
    # a table of its own, so that a join may split a template with very many lines
    recurring = materialize(
        named.groupBy("template", *document)
        .agg(F.min("line_no").alias("line_no"))
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(*document, "line_no")).alias("first"))
        .filter(F.col("n_docs") >= min_docs),
        "recurring",
    )
    return named, recurring


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text_key and the sorted numbers of the lines to drop, for documents with any."""
    named, recurring = line_templates(docs, id_col, text_col, **options)
    place = F.struct("doc_id", "text_key", "line_no")
    return (
        named.join(recurring, "template")
        .filter(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set("line_no")).alias("lines"))
    )


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None, **options
) -> DataFrame:
    """`docs` with the recurring lines cut out of the text; every row stays, and so do its
    other columns. A text that loses all its lines becomes empty, null stays null. With
    `dropped_col` the number of lines dropped is added. An empty table gives an empty one.
    """
    id_name, key_name, lines_name = (free_name(docs, n) for n in ("dropped_id", "dropped_key", "dropped_lines"))
    gone = dropped_lines(docs, id_col, text_col, **options).select(
        F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name), F.col("lines").alias(lines_name)
    )
    text = column(text_col)
    key = free_name(docs, "text_key")
    joined = docs.withColumn(key, F.xxhash64(text)).join(
        gone.hint("shuffle_hash"),
        column(id_col).eqNullSafe(F.col(id_name)) & (F.col(key) == F.col(key_name)),
        "left",
    )
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(lines_name), i))
    result = joined.withColumn(
        text_col, F.when(F.col(lines_name).isNull(), text).otherwise(F.array_join(left, "\n"))
    )
    if dropped_col:
        result = result.withColumn(dropped_col, F.coalesce(F.size(lines_name), F.lit(0)))
    return result.drop(id_name, key_name, lines_name, key)
