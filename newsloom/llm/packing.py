"""Packing of token sequences by lexical retrieval.

Documents are encoded once and written to the shared folder with the smallest hash of their
words, so that sorting by it brings texts with words in common together. A range partition
by that hash and the id, however many documents share the hash, deals them out in parts of
bounded size. Each part is a series of index shards.

A shard is an inverted index over its documents with BM25 weights. A seed document opens a
window; its most telling terms ask the index, and unused neighbours fill the window in the
order of their score, the last one up to the brim. What is left of that one opens the next
window and asks for itself. Only the last window of a part is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import column
from newsloom.llm.tokens import WordEncoder, chunks
from newsloom.session import materialize

WINDOW = 2048
END_ID = 1
#: Tokens of a task's part, and of an index shard in it.
PART_TOKENS = 8_000_000
SHARD_TOKENS = 1_000_000
#: Terms of a seed that ask the index.
QUERY_TERMS = 24
K1, B = 1.2, 0.75

_ENCODED = "row_hash long, doc_id {id}, tokens long, ids binary"
_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _encoder(description, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = WordEncoder(description.value), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in chunks(whole, 1):
                ids, bounds, least = encoder.encode(batch.column(1))
                packed = [
                    squeeze.compress(np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes())
                    for a, b in zip(bounds.tolist(), bounds[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least.view(np.int64)),
                        batch.column(0).cast(id_type),
                        pa.array(np.diff(bounds) + 1),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["row_hash", "doc_id", "tokens", "ids"],
                )

    return run


class Index:
    """Inverted index with BM25 weights over documents given as id arrays."""

    def __init__(self, docs: list[np.ndarray], query_terms: int = QUERY_TERMS):
        self.n = len(docs)
        terms, counts, sizes = [], [], np.empty(self.n, np.int64)
        for i, ids in enumerate(docs):
            ids = np.sort(ids, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            terms.append(ids[first])
            counts.append(np.diff(first, append=len(ids)))
            sizes[i] = len(first)
        term, count = np.concatenate(terms), np.concatenate(counts)
        owner = np.repeat(np.arange(self.n), sizes)
        length = np.fromiter(map(len, docs), np.int64, self.n)
        _, coded, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / length.mean())
        weight = idf[coded] * count * (K1 + 1) / (count + norm[owner])
        by_term = np.argsort(coded, kind="stable")
        self.posting_doc, self.posting_weight = owner[by_term], weight[by_term]
        self.begins = np.concatenate(([0], np.cumsum(df)))
        self.terms, self.weights = coded, weight
        self.doc_begins = np.concatenate(([0], np.cumsum(sizes)))
        self.query_terms = query_terms

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term, best score first, ties in order."""
        a, b = self.doc_begins[doc], self.doc_begins[doc + 1]
        terms = self.terms[a:b]
        if len(terms) > self.query_terms:
            terms = terms[np.argpartition(-self.weights[a:b], self.query_terms)[: self.query_terms]]
        spans = [slice(self.begins[t], self.begins[t + 1]) for t in terms]
        scores = np.bincount(
            np.concatenate([self.posting_doc[s] for s in spans]),
            np.concatenate([self.posting_weight[s] for s in spans]),
            self.n,
        )
        scores[used] = 0
        hits = np.flatnonzero(scores > 0)
        return hits[np.argsort(-scores[hits], kind="stable")]


class Windows:
    """The windows of one part; pieces go to `rows` as (number, start, length, window, offset)."""

    def __init__(self, width: int):
        self.width, self.window, self.filled = width, 0, 0

    def place(self, doc: int, length: int, start: int, most: int | None = None) -> list[tuple]:
        """Place ids from `start`, at most `most` of them; windows open as they fill."""
        rows, end = [], length if most is None else min(length, start + most)
        while start < end:
            if self.filled == self.width:
                self.window, self.filled = self.window + 1, 0
            step = min(end - start, self.width - self.filled)
            rows.append((doc, start, step, self.window, self.filled))
            self.filled += step
            start += step
        return rows

    @property
    def room(self) -> int:
        return self.width - self.filled


def pack_shard(docs: list[np.ndarray], windows: Windows, query_terms: int = QUERY_TERMS) -> list[tuple]:
    """Pieces of all documents of a shard, each id in one piece."""
    index = Index(docs, query_terms)
    used = np.zeros(len(docs), bool)
    rows: list[tuple] = []
    rest: tuple[int, int] | None = None
    following = 0
    while True:
        if rest:
            seed, start = rest
            rest = None
        else:
            while following < len(docs) and used[following]:
                following += 1
            if following == len(docs):
                return rows
            seed, start = following, 0
            used[seed] = True
        rows += windows.place(seed, len(docs[seed]), start)
        if not windows.room or used.all():
            continue
        for near in index.neighbours(seed, used).tolist():
            used[near] = True
            room, length = windows.room, len(docs[near])
            rows += windows.place(near, length, 0, room)
            if length > room:
                rest = (near, room)
            if not windows.room:
                break


def _packer(width: int, shard_tokens: int, query_terms: int, with_ids: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        part = TaskContext.get().partitionId() << 33
        windows = Windows(width)
        names, docs, tokens = [], [], 0

        def packed() -> pa.RecordBatch:
            rows = pack_shard(docs, windows, query_terms)
            number, start, length, window, offset = (np.array(c, np.int64) for c in zip(*rows))
            parts = [docs[d][s : s + n].astype("<u4") for d, s, n, _, _ in rows]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in number.tolist()], id_type),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array([len(docs[i]) for i in number.tolist()], pa.int64()),
                    pa.array(window + part),
                    pa.array(offset),
                    pa.array(parts if with_ids else [None] * len(parts), pa.list_(pa.int32())),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                docs.append(np.frombuffer(expand.decompress(ids.as_py()), "<u4"))
                tokens += len(docs[-1])
                if tokens >= shard_tokens:
                    yield packed()
                    names, docs, tokens = [], [], 0
        if docs:
            yield packed()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    part_tokens: int = PART_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    query_terms: int = QUERY_TERMS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and the ids themselves with `with_ids`.

    Every id of every document lies in one piece; `end_id` ends each document. Null and
    empty texts are that one id. Repeated rows and null ids are documents of their own. An
    empty table gives an empty result. Other columns are not looked at. The tokenizer's file
    is read on the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        description = spark.sparkContext.broadcast(file.read())
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = _arrow_type(kind)
    encoded = materialize(
        rows.mapInArrow(_encoder(description, end_id, arrow), _ENCODED.format(id=kind.simpleString())), "encoded"
    )
    total = encoded.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    pieces = (
        encoded.repartitionByRange(parts, "row_hash", "doc_id", F.xxhash64("ids"))
        .sortWithinPartitions("row_hash", "doc_id", F.xxhash64("ids"))
        .select("doc_id", "ids")
        .mapInArrow(
            _packer(window, shard_tokens, query_terms, with_ids, arrow), _PIECES.format(id=kind.simpleString())
        )
    )
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids) of pieces made `with_ids`, padded to the window."""
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn(
        "ids", F.concat("ids", F.array_repeat(F.lit(pad_id), window - F.size("ids")))
    )


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
