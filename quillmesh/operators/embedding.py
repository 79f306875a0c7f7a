"""Model seams: clients are passed in; a hashing embedder and an echo model stand in for services."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import retrieval_prefix

Embedder = Callable[[list[str], str], "np.ndarray"]
BATCH, RETRIES = 16, 4


class ServiceError(RuntimeError):
    """A service failed; the message never holds a key."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(" ".join(message.split())[:500])
        self.status, self.retry_after = status, retry_after


def with_retries(call: Callable[[], object], retries: int = RETRIES, base: float = 1.0, cap: float = 30.0, sleep=time.sleep):
    """Calls again after 429 and statuses from 500 on, after the seconds that the service asks for, at most a minute, or
    else backing off exponentially with jitter; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except ServiceError as e:
            if attempt == retries or not (e.status == 429 or (e.status or 0) >= 500):
                raise
            sleep(min(60.0, e.retry_after) if e.retry_after is not None else min(cap, base * 2**attempt) * (0.5 + random.random() / 2))


def validate(matrix: np.ndarray, n: int, dimension: int) -> np.ndarray:
    """The matrix as float32, if it has the shape asked for, only finite numbers and no zero row."""
    m = np.asarray(matrix, np.float32)
    if m.shape != (n, dimension):
        raise ValueError(f"expected {(n, dimension)} numbers, got {m.shape}")
    if not np.isfinite(m).all() or not (np.linalg.norm(m, axis=1) > 0).all():
        raise ValueError("vectors must be finite and not zero")
    return m


def hashing_embedder(dimension: int) -> Embedder:
    """Signed counts of hashed words; deterministic."""

    def embed(texts: list[str], task: str) -> np.ndarray:
        from xxhash import xxh64_intdigest

        out = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            out[i, 0] = 1e-3
            for w in text.lower().split():
                h = xxh64_intdigest(w)
                out[i, h % dimension] += 1 if h >> 63 else -1
        return out

    return embed


def _vectors(texts: pa.Array, embedder: Embedder, dimension: int, task: str, batch: int) -> pa.Array:
    """Unit vectors of a column's texts; of the texts only those of a call are Python strings at a time."""
    filled = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    out = np.empty((len(filled), dimension), np.float32)
    for start in range(0, len(filled), batch):
        sent = texts.take(pa.array(filled[start : start + batch])).to_pylist()
        m = validate(with_retries(lambda t=sent: embedder(t, task)), len(sent), dimension)
        out[start : start + batch] = m / np.linalg.norm(m, axis=1, keepdims=True)
    lengths = np.zeros(len(texts), np.int32)
    lengths[filled] = dimension
    ends = np.append(np.int32(0), np.cumsum(lengths, dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(lengths == 0))


def embed(df: DataFrame, text: str, embedder: Embedder, dimension: int, task: str = "document", model: str = "hashing", batch: int = BATCH) -> DataFrame:
    """Adds ``embedding``: prefixed, sent in batches with retries, validated and scaled to unit length; null for a null
    text, which is not sent."""
    if dimension < 1 or task not in ("document", "query") or batch < 1:
        raise ValueError("dimension and batch are at least 1, the task is document or query")

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _vectors(texts, embedder, dimension, task, batch)

    return df.withColumn("embedding", run(retrieval_prefix(F.col(text), model, task)))


def fingerprint(corpus_hash: str, n: int, provider: str, model: str, dimension: int) -> str:
    return "|".join(map(str, (corpus_hash, n, provider, model, dimension)))


def content_digest(df: DataFrame) -> str:
    """Order-free digest of a frame: row count, and xor and sum of row hashes."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()
    return f"{r.n}-{(r.x or 0) & (2**64 - 1):016x}-{int(r.s or 0):x}"


def resume(chunks: DataFrame, index: DataFrame | None, mark: str) -> DataFrame:
    """Chunks that the index lacks; an index made with another fingerprint is refused."""
    if index is None:
        return chunks
    if not index.filter(F.col("fingerprint") != mark).isEmpty():
        raise ValueError("the index was built with another corpus, model or dimension; restart it")
    return chunks.join(index.select("chunk_id"), "chunk_id", "left_anti")


def build_index(chunks: DataFrame, path: str, embedder: Embedder, dimension: int, mark: str, restart: bool = False, **options) -> DataFrame:
    """Appends what is missing to the Parquet index at ``path``; a rerun after a failure goes on from there."""
    spark = chunks.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    index = spark.read.parquet(path) if there and not restart else None
    new = embed(resume(chunks, index, mark), "text", embedder, dimension, **options).withColumn("fingerprint", F.lit(mark))
    new.write.mode("overwrite" if restart else "append").parquet(path)
    return spark.read.parquet(path)


def embed_query(text: str, embedder: Embedder, dimension: int, model: str = "hashing") -> list[float]:
    """One text as a query's unit vector, on the driver."""
    sent = f"search_query: {text}" if model.split(":", 1)[0].lower() == "nomic-embed-text" else text
    m = validate(with_retries(lambda: embedder([sent], "query")), 1, dimension)
    return (m[0] / np.linalg.norm(m[0])).astype(float).tolist()


def smoke_test(chunks: DataFrame, embedder: Embedder, dimension: int, **options) -> DataFrame:
    """The first two chunks by id, embedded; nothing is written."""
    return embed(chunks.orderBy("chunk_id").limit(2), "text", embedder, dimension, **options)


def answer(df: DataFrame, model: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Adds ``answer`` of a model to ``prompt``, and ``latency_ms``, retries included."""

    @F.pandas_udf("answer string, latency_ms long")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for p in s:
            began = time.monotonic()
            rows.append((with_retries(lambda p=p: model(p)), round((time.monotonic() - began) * 1000)))
        return pd.DataFrame(rows, columns=["answer", "latency_ms"], index=s.index)

    return df.withColumn("_answer", run(prompt)).select("*", "_answer.answer", "_answer.latency_ms").drop("_answer")


def remaining(done: int, total: int, seconds: float) -> tuple[float, float | None]:
    """Rows a second so far, and the seconds that the rest will take; unknown before the first row."""
    rate = done / seconds if seconds > 0 else 0.0
    return rate, (total - done) / rate if rate else None
