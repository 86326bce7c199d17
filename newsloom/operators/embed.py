"""Text to vectors through a provider, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.models import shuffle_tasks, spread
from newsloom.functions.text import strip
from newsloom.operators.responses import ResponseLog, logged
from newsloom.providers import Embedder

# Texts handed to the model at once.
_BATCH = 256


def _encode(
    embed: Embedder, texts: list[str], fail_fast: bool, dim: int | None
) -> list[np.ndarray | None]:
    """Vectors of `texts`; if the batch fails each text is tried alone, and one that
    fails by itself has none, or ends the job if `fail_fast`."""
    try:
        vectors = np.asarray(embed(texts), dtype=np.float64)
        if vectors.ndim != 2 or len(vectors) != len(texts) or dim not in (None, vectors.shape[1]):
            raise ValueError(f"vectors of shape {vectors.shape} for {len(texts)} texts, dim {dim}")
        return list(vectors)
    except Exception:
        if len(texts) == 1:
            if fail_fast:
                raise
            return [None]
    return [vector for text in texts for vector in _encode(embed, [text], fail_fast, dim)]


def _unit(vector: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.dot(vector, vector))
    return vector / length if length > 0 else vector


def vectors_of(
    text: Column,
    provider: Callable[[], Embedder],
    normalize: bool,
    batch_size: int = _BATCH,
    fail_fast: bool = False,
    dim: int | None = None,
) -> Column:
    """`array<float>` per text; null for null texts and for texts the model failed on."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = provider()
        for batch in batches:
            texts = batch.to_pylist()
            filled = [i for i, t in enumerate(texts) if t is not None]
            out: list[np.ndarray | None] = [None] * len(texts)
            for lo in range(0, len(filled), batch_size):
                part = filled[lo : lo + batch_size]
                for i, vector in zip(part, _encode(embed, [texts[i] for i in part], fail_fast, dim)):
                    if vector is not None:
                        out[i] = (_unit(vector) if normalize else vector).astype(np.float32)
            yield pa.array(out, type=pa.list_(pa.float32()))

    # A model call: neither repeated nor moved by the optimizer.
    return encode.asNondeterministic()(text)


def embed_chunks(
    chunks: DataFrame,
    provider: Callable[[], Embedder],
    text: str = "chunk_text",
    parallelism: int | None = None,
    fail_fast: bool = False,
    dim: int | None = None,
    log: ResponseLog | None = None,
) -> DataFrame:
    """Add `embedding`, of unit length; blank text has none and keeps its row. A text that
    the model fails on, or gives a vector of another length than `dim`, has none either, or
    ends the job if `fail_fast`.

    Rows are spread over `parallelism` tasks first, by default as many as a shuffle has,
    since inputs behind a limit sit in one. With a `log`, texts whose vector is there are
    not embedded again, and equal texts once; a round has no more tasks than it has batches.
    """
    filled = F.when(strip(F.col(text)) != "", F.col(text))

    def embedded(asked: DataFrame, of: Column, tasks: int | None = parallelism) -> DataFrame:
        vectors = vectors_of(of, provider, normalize=True, fail_fast=fail_fast, dim=dim)
        return spread(asked, tasks).withColumn("embedding", vectors)

    if log is None:
        return embedded(chunks, filled)
    asked = chunks.withColumn("_filled", filled)
    tasks = parallelism or min(shuffle_tasks(chunks.sparkSession), -(-log.round_rows // _BATCH))
    found = logged(
        asked, log, ("_filled",), lambda part: embedded(part, F.col("_filled"), tasks), ("embedding",), F.col("embedding").isNotNull()
    )
    return found.drop("_filled")


def embed_queries(
    queries: DataFrame,
    provider: Callable[[], Embedder],
    text: str = "query",
    parallelism: int | None = None,
) -> DataFrame:
    """Add `embedding`, as the model returns it. Rows are spread as by `embed_chunks`."""
    return spread(queries, parallelism).withColumn("embedding", vectors_of(F.col(text), provider, normalize=False))
