"""Embedding of open canonical postings whose content changed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, DIMENSIONS = 100, 256

#: texts and their role ('document' or 'query') to vectors
Embedder = Callable[[list[str], str], "np.ndarray"]


def embedding_text(title: Column, company: Column, location: Column, department: Column, description: Column) -> Column:
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"\n{name}: "), c)).otherwise(F.lit(""))
    return F.concat(title, F.lit(" at "), company, line("Location", location), line("Team", department), F.lit("\n\n"), description)


def pending(postings: DataFrame) -> DataFrame:
    """Open canonical postings without embedding or with one of older content."""
    stale = F.col("embedding").isNull() | ~F.col("embedding_hash").eqNullSafe(F.col("content_hash"))
    return postings.where(F.col("closed_at").isNull() & F.col("canonical_id").isNull() & stale)


def pending_work(postings: DataFrame, companies: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, text, content_hash) of what is to embed, the smallest ids first if limited."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    text = embedding_text(F.col("title"), F.col("company_name"), F.col("location"), F.col("department"), F.col("description"))
    work = pending(postings)
    if limit is not None:
        work = work.orderBy("id").limit(limit)
    return work.join(names, "company_id").select("id", text.alias("text"), "content_hash")


def java_hash(word: str) -> int:
    """31-polynomial hash over UTF-16 units as a signed 32-bit number."""
    h = 0
    for u in np.frombuffer(word.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = (h * 31 + u) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def word_counts(texts: list[str], role: str = "document") -> np.ndarray:
    """An embedder that needs no model: hashed counts of words of more than two characters."""
    import re

    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        for w in re.split(r"\W+", t.lower(), flags=re.ASCII):
            if len(w) > 2:
                out[i, java_hash(w) % DIMENSIONS] += 1
    return out


def retrying(embed: Embedder, retryable: Callable[[Exception], bool], attempts: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """Calls again after a retryable error, waiting twice as long each time."""

    def call(texts: list[str], role: str) -> np.ndarray:
        for attempt in range(1, attempts + 1):
            try:
                return embed(texts, role)
            except Exception as e:
                if attempt == attempts or not retryable(e):
                    raise
                sleep(wait * 2 ** (attempt - 1))
        raise AssertionError

    return call


def retryable_status(status: int) -> bool:
    return status == 429 or status >= 500


def _vectors(embed: Embedder, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                error = None
                try:
                    got = np.asarray(embed([t or "" for t in part.column("text").to_pylist()], "document"), np.float32)
                    if len(got) != part.num_rows:
                        error = f"{len(got)} embeddings for {part.num_rows} texts"
                except Exception as e:
                    error = str(e) or type(e).__name__
                vectors = pa.nulls(part.num_rows, pa.list_(pa.float32())) if error else pa.array(list(got), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), vectors, part.column("content_hash"), pa.array([error] * part.num_rows, pa.string())], names=["id", "embedding", "embedding_hash", "error"])
                if error:  # a service that fails is not asked again by this task
                    return

    return run


def attempted(postings: DataFrame, companies: DataFrame, embed: Embedder | None, limit: int | None = None, batch: int = BATCH) -> DataFrame:
    """(id, embedding, embedding_hash, error) of the pending postings, by requests of ``batch`` texts: those of a
    request that failed have its error and no embedding, and its task leaves the rest pending. Without an embedder
    there are none.
    """
    work = pending_work(postings, companies, limit)
    if embed is None:
        work = work.limit(0)
        embed = word_counts
    return work.mapInArrow(_vectors(embed, batch), "id long, embedding array<float>, embedding_hash string, error string")


def embed_pending(postings: DataFrame, companies: DataFrame, embed: Embedder | None, limit: int | None = None, batch: int = BATCH) -> DataFrame:
    """(id, embedding, embedding_hash) of the pending postings; a request that fails is an error."""
    rows = attempted(postings, companies, embed, limit, batch)
    return rows.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))).drop("error")
