"""Plug-in point for embeddings, with a deterministic one that needs no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from quern.session import ship_package


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed feature hashing of words and CJK characters, to unit length; a text without any is all zero."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in regex.findall(r"\p{Han}|[^\W\p{Han}]+", (t or "").lower()):
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dim] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, key: str, content: str, model: Callable[[list[str]], np.ndarray] = hashed_embedding, dim: int = 64, name: str = "hash-64") -> DataFrame:
    """key, embedding, embedding_model, embedding_dim; a model that returns another count or length raises."""
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            v = np.asarray(model(["" if t is None else t for t in batch.column(1).to_pylist()]), np.float32)
            if v.shape != (batch.num_rows, dim):
                raise ValueError(f"{name} returned {v.shape} for {batch.num_rows} texts of dimension {dim}")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([name] * batch.num_rows), pa.array([dim] * batch.num_rows, pa.int32())], [key, "embedding", "embedding_model", "embedding_dim"])

    return df.select(key, content).mapInArrow(run, f"{key} {kind}, embedding array<float>, embedding_model string, embedding_dim int")
