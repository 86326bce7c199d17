"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

Words become numbers in order of first sight. Windows of each n-gram length get a rolling
hash: the hash of n words is that of the first n - 1 times a factor plus the next word, so
that one array operation per length covers the whole text. Equal hashes are found by
sorting and compared word by word. Characters of words inside a window that occurred before
count once, however many windows cover them; first occurrences are no repetition. A longer window can only repeat where a shorter one does,
so that lengths after one without repeats are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, column, free_name

BASE_LENGTH = 5
MIN_WORDS = 10
#: Largest share of word characters in repeated n-grams, by n; then of characters in
#: repeated lines. These are public thresholds for web text.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.20

_WORD = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ngram_share double, line_share double, base_failed boolean, kept boolean"


def _covered(words: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Words inside the windows of n words at `starts`."""
    change = np.zeros(words + 1, np.int64)
    change[starts] += 1
    change[starts + n] -= 1
    return np.cumsum(change[:-1]) > 0


def repeated_words(ids: np.ndarray, lengths: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length, which words lie in a window of so many words that occurs twice or more,
    and which in one that occurred before. Lengths that cannot repeat, as a shorter one does
    not, are left out."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(32)
    hashes, at = mixed, 1
    for n in sorted(lengths):
        if len(ids) <= n:
            break
        while at < n:
            hashes = hashes[:-1] * _FACTOR + mixed[at:]
            at += 1
        order = np.argsort(hashes, kind="stable")
        by_hash = hashes[order]
        same = by_hash[1:] == by_hash[:-1]
        if not same.any():
            break
        windows = np.lib.stride_tricks.sliding_window_view(ids, n)
        often, later = np.unique(np.concatenate((order[:-1][same], order[1:][same]))), order[1:][same]
        if (windows[order[:-1][same]] != windows[later]).any():  # two windows share a hash
            _, first, number, count = np.unique(
                windows, axis=0, return_index=True, return_inverse=True, return_counts=True
            )
            often = np.flatnonzero(count[number.ravel()] > 1)
            later = np.setdiff1d(often, first)
        if not len(often):
            break
        found[n] = _covered(len(ids), often, n), _covered(len(ids), later, n)
    return found


def measures(text: str | None) -> tuple:
    """The values of FIELDS for one text; null counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    chars = np.fromiter(map(len, words), np.int64, len(words))
    word_chars = int(chars.sum())
    found = repeated_words(ids, sorted({BASE_LENGTH, *NGRAM_SHARES})) if len(numbers) < len(words) else {}
    repeats = int(found[BASE_LENGTH][0].sum()) if BASE_LENGTH in found else 0

    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += len(line)
        elif _WORD.search(line):
            seen.add(line)
    line_share = dup_chars / len(text) if text else 0.0
    shares = {n: int(chars[later].sum()) / word_chars for n, (_, later) in found.items()}
    base_failed = len(words) < MIN_WORDS or 100 * repeats > 20 * len(words)
    repetitive = line_share > LINE_SHARE or any(shares.get(n, 0.0) > most for n, most in NGRAM_SHARES.items())
    return (
        len(words),
        word_chars,
        sum(map(text.count, _SYMBOLS)),
        dup_lines,
        repeats,
        shares.get(min(NGRAM_SHARES), 0.0),
        line_share,
        base_failed,
        not (base_failed or repetitive),
    )


_NAMES = [field.split()[0] for field in FIELDS.split(", ")]


def _rows(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t) for t in texts], columns=_NAMES)


def repetition(text: Column) -> Column:
    """Struct of the measures of a text."""
    return F.pandas_udf(_rows, FIELDS)(text)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and the measures. Whole texts are read. Null and
    empty texts have no words and fail. Repeated rows and null ids pass through. An empty
    table gives an empty result. Other columns are not looked at."""
    return docs.select(column(id_col).alias("doc_id"), repetition(column(text_col)).alias("m")).select(
        "doc_id", "m.*"
    )


def keep_varied(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns."""
    name = free_name(docs, "repetition")
    return docs.withColumn(name, repetition(column(text_col))).filter(F.col(name)["kept"]).drop(name)
