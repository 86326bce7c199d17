"""Sentence splitting, chunk folding and text normalisation as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv

# Unicode white space plus the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim Unicode white space, U+3000 included, from both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def split_sentences(content: Column, delimiters: str = fv.SENTENCE_DELIMITERS) -> Column:
    """Sentences of `content`, stripped, blanks dropped; `delimiters` is a regular expression."""
    return F.filter(F.transform(F.split(content, delimiters), strip), lambda s: s != "")


# Sentences of a block in the fold.
_FOLD_BLOCK = 64

_SPANS = "array<struct<start:int,stop:int,tail:int>>"


def _part(array: Column, start: Column, stop: Column) -> Column:
    """Elements from `start` up to `stop`. Picks them one by one, where `slice` goes through
    the whole array."""
    places = F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(array, i))


def fold_spans(
    sentences: Column, max_length: int = fv.MAX_LENGTH, overlap: int = fv.OVERLAP, terminator: str = fv.SENTENCE_TERMINATOR
) -> Column:
    """Which sentences make up each chunk, and how many characters of the chunk before it
    begins with: an array of start, stop and tail. Only lengths are folded, no text.

    An accumulator is copied at every step. So one fold over blocks of sentences carries only
    how each block begins, and each block's spans are then folded by themselves.
    """
    count = F.size(sentences)
    firsts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(_FOLD_BLOCK)))

    def sizes(first: Column) -> Column:
        return F.transform(_part(sentences, first, F.least(first + _FOLD_BLOCK, count)), F.length)

    def state(length, at, start, tail, *done) -> Column:
        numbers = zip(("length", "at", "start", "tail"), (length, at, start, tail))
        return F.struct(*[x.cast("int").alias(name) for name, x in numbers], *[d.alias("done") for d in done])

    def step(acc: Column, size: Column, *done: Column) -> Column:
        """The state behind a sentence; `done` is the list of spans, if there is one."""
        length, at, start, tail = (acc[c] for c in ("length", "at", "start", "tail"))
        kept = F.least(length, F.lit(overlap))
        span = F.struct(start.alias("start"), at.alias("stop"), tail.alias("tail"))
        closed = state(kept + size, at + 1, at, kept, *[F.array_append(d, span) for d in done])
        first = state(size, at + 1, start, tail, *done)
        grown = state(length + size + len(terminator), at + 1, start, tail, *done)
        full = length + size > max_length
        return F.when(full & (length > 0), closed).when(full, first).otherwise(grown)

    zero = F.lit(0)
    begun = state(zero, zero, zero, zero)

    def carry(acc: Column, first: Column) -> Column:
        now = acc["now"]
        return F.aggregate(
            sizes(first), now, lambda acc, size: step(acc, size), lambda end: F.struct(end.alias("now"), F.array_append(acc["all"], now).alias("all"))
        )

    nothing = F.array().cast("array<struct<length:int,at:int,start:int,tail:int>>")
    begins = F.aggregate(firsts, F.struct(begun.alias("now"), nothing.alias("all")), carry, lambda end: end["all"])

    def spans(begin: Column) -> Column:
        """Spans that end in a block, and the last of all in the last block."""
        fields = [begin[c] for c in ("length", "at", "start", "tail")]
        return F.aggregate(
            sizes(begin["at"]),
            state(*fields, F.array().cast(_SPANS)),
            lambda acc, size: step(acc, size, acc["done"]),
            lambda end: F.when(
                end["at"] == count,
                F.array_append(end["done"], F.struct(end["start"], end["at"].alias("stop"), end["tail"])),
            ).otherwise(end["done"]),
        )

    return F.flatten(F.transform(begins, spans))


def with_chunks(
    df: DataFrame,
    sentences: Column,
    name: str,
    max_length: int = fv.MAX_LENGTH,
    overlap: int = fv.OVERLAP,
    terminator: str = fv.SENTENCE_TERMINATOR,
) -> DataFrame:
    """`df` with an array of chunks that each start with the tail of the one before; null or
    empty without sentences.

    A sentence that would push the running chunk past `max_length` closes it and is
    appended to its last `overlap` characters without a terminator; any other
    sentence is appended with one. A chunk is never cut, so a long sentence makes
    a long chunk. Time and memory grow with the text, however many chunks it gives.

    Each step is a column of its own that the next uses more than once, which keeps the
    optimizer from evaluating it again for every element.
    """
    if max_length < 1 or overlap < 0:
        raise ValueError("max_length must be positive and overlap must not be negative")
    texts, spans, bodies, ends = (F.col(c) for c in ("_sentences", "_spans", "_bodies", "_ends"))

    def body(x: Column) -> Column:
        """The sentences of a chunk behind its tail: no mark follows the one that opened it."""
        count = x["stop"] - x["start"]
        first = F.get(texts, x["start"])
        rest = F.array_join(_part(texts, x["start"] + 1, x["stop"]), terminator)
        fits = (x["start"] == 0) & (F.length(first) <= max_length)
        mark = F.lit(terminator)
        return F.concat(
            first, F.when(fits, mark).otherwise(""), rest, F.when(count > 1, mark).otherwise("")
        )

    def chunk(x: Column, i: Column) -> Column:
        # a tail seldom reaches back over several bodies, and over no more than it has characters
        last = F.coalesce(F.get(ends, i - 1), F.lit(""))
        several = F.array_join(_part(ends, i - F.least(i, F.lit(overlap), F.size(ends)), i), "")
        before = F.when(F.length(last) >= x["tail"], last).otherwise(several)
        return F.concat(F.right(before, x["tail"]), F.get(bodies, i))

    return (
        df.withColumn("_sentences", sentences)
        .withColumn("_spans", F.when(F.size(texts) > 0, fold_spans(texts, max_length, overlap, terminator)))
        .withColumn("_bodies", F.transform(spans, body))
        .withColumn("_ends", F.transform(bodies, lambda b: F.right(b, F.lit(overlap))))
        .withColumn(name, F.transform(spans, chunk))
        .drop("_sentences", "_spans", "_bodies", "_ends")
    )


def classifier_text(title: Column, summary: Column) -> Column:
    """One line per article for the classifier; a fixed text if both parts are missing."""
    line = F.concat_ws(
        fv.PART_SEPARATOR,
        F.concat(F.lit(fv.TITLE_PREFIX), null_if_empty(title)),
        F.concat(F.lit(fv.SUMMARY_PREFIX), null_if_empty(summary)),
    )
    return F.coalesce(null_if_empty(line), F.lit(fv.NO_TEXT))
