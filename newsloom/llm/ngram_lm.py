"""Stupid-backoff scores of documents, from n-gram counts of the whole corpus.

Documents are dealt into blocks of bounded bytes. Each block counts its n-grams, named by
64-bit hashes, and sends one packed row of hashes and counts to every part of the count
table, which is cut by hash. A part adds up what the blocks sent and answers each of them in
its order. The blocks join the answers with their n-grams, take away each document's own
counts, and sum the logarithms of the scores per document.

So a frequent n-gram arrives once from each block, not once from each document, and no
task meets more than one block or one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import column, word_count

ORDER = 2
BACKOFF = 0.4
#: Bytes of text in a block, and of the text whose n-grams fill a part of the count table.
BLOCK_BYTES = 8 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

_RESULT = "doc_id {id}, n_words long, log_score double, mean_log_score double"


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


class Grams:
    """The n-grams of a block of texts: `hashes[k]` has those of order k + 1 in text order,
    `ends[k]` the place of their last word, `owner` each word's text."""

    def __init__(self, texts: pa.Array, order: int):
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
        words = of_word[coded.indices.to_numpy()][real]
        self.owner = owner[real]
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.hashes, self.ends = [_mixed(words)], [np.arange(len(words))]
        rolled = words
        for k in range(1, order):
            rolled = _mixed(rolled[:-1] * _FACTOR + np.uint64(k)) + words[k:]
            inside = place[k:] >= k
            self.hashes.append(_mixed(rolled[inside] * _FACTOR + np.uint64(k)))
            self.ends.append(np.flatnonzero(inside) + k)


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _asker(order: int, parts: int):
    """Rows (part, block, hashes, counts): a block's distinct n-grams with their counts."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        grams = Grams(table.column("text").combine_chunks(), order)
        names, counts = np.unique(np.concatenate(grams.hashes), return_counts=True)
        cuts = np.searchsorted(_part_of(names, parts), np.arange(parts + 1))
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in rows], pa.int32()),
                "block": pa.array([block] * len(rows), pa.int32()),
                "hashes": pa.array([_squeezed(np.diff(names[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
                "counts": pa.array([_squeezed(counts[a:b]) for _, a, b in rows], pa.binary()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Adds up a part of the count table; rows (part, block, counts) in each block's order."""
    hashes = [np.cumsum(_expanded(x.as_py()), dtype=np.uint64) for x in table.column("hashes")]
    counts = [_expanded(x.as_py()) for x in table.column("counts")]
    names, code = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.zeros(len(names), np.uint64)
    np.add.at(totals, code, np.concatenate(counts))
    answers = np.split(totals[code], np.cumsum([len(h) for h in hashes])[:-1])
    return pa.table(
        {
            "part": table.column("part"),
            "block": table.column("block"),
            "counts": pa.array([_squeezed(a) for a in answers], pa.binary()),
        }
    )


def _scorer(order: int, backoff: float, corpus_words: int, id_type: pa.DataType):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(texts.column("text").combine_chunks(), order)
        names, code = np.unique(np.concatenate(grams.hashes), return_inverse=True)
        by_part = np.argsort(answers.column("part").to_numpy()).tolist()
        stored = [_expanded(answers.column("counts")[i].as_py()) for i in by_part]
        totals = (np.concatenate(stored) if stored else np.empty(0, np.uint64)).astype(np.int64)
        codes = np.split(code, np.cumsum([len(h) for h in grams.hashes])[:-1])
        n = len(grams.owner)
        others = corpus_words - grams.sizes[grams.owner]
        score, shorter = np.zeros(n), np.zeros(n, np.int64)
        for k, (mine, ends) in enumerate(zip(codes, grams.ends)):
            key = grams.owner[ends] * len(names) + mine
            _, place, own = np.unique(key, return_inverse=True, return_counts=True)
            elsewhere = totals[mine] - own[place]
            if k == 0:
                score = np.maximum(elsewhere, 1) / (others + 1)
            else:
                seen = elsewhere > 0
                score[ends] = np.where(
                    seen, elsewhere / np.maximum(shorter[ends - 1], 1), backoff * score[ends]
                )
            shorter = np.zeros(n, np.int64)
            shorter[ends] = elsewhere
        total = np.bincount(grams.owner, np.log(score), len(grams.sizes)) if n else np.zeros(len(grams.sizes))
        mean = pd.Series(total / np.maximum(grams.sizes, 1)).where(grams.sizes > 0)
        return pa.table(
            {
                "doc_id": texts.column("doc_id").cast(id_type),
                "n_words": pa.array(grams.sizes),
                "log_score": pa.array(total),
                "mean_log_score": pa.array(mean, from_pandas=True),
            }
        )

    return run


def backoff_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, log_score, mean_log_score.

    A word after k known words scores c(k words, word) / c(k words) for the largest k below
    `order` with such a count, times `backoff` for each step down; with none, it scores
    (c(word) or 1) / (words + 1). All counts are those of all other documents of the corpus.
    `log_score` sums natural logarithms. No words: 0 and a null mean. Repeated rows count as
    documents of their own. An empty table gives an empty result. Other columns are not
    looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    size, words = rows.agg(F.sum(F.octet_length("text")), F.sum(word_count(F.col("text")))).first()
    parts = max(1, -(-(size or 0) // block_bytes))
    blocks = rows.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("block"))
    asked = blocks.groupBy("block").applyInArrow(
        _asker(order, parts), "part int, block int, hashes binary, counts binary"
    )
    answered = asked.groupBy("part").applyInArrow(_answer, "part int, block int, counts binary")
    return (
        blocks.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(_scorer(order, backoff, words or 0, to_arrow_type(kind)), _RESULT.format(id=kind.simpleString()))
    )
