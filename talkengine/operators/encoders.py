"""Pluggable encoders: Arrow batches of texts in, unit vectors out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def encoded(texts: DataFrame, column: str, make: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "") -> DataFrame:
    """(column, vector): ``make`` builds the model once per task, its result maps texts to rows of a matrix, which are
    brought to unit length; blank texts and zero rows get zero vectors."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            m = np.asarray(model([prefix + (t or "") for t in b[column]]), np.float32)
            m[[not (t or "").strip() for t in b[column]]] = 0
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.DataFrame({column: b[column], "vector": list(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))})

    return texts.select(column).mapInPandas(run, f"{column} string, vector array<float>")


def hashing(dim: int) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic stand-in: the bytes of sha256 as a vector."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            raw = hashlib.sha256(t.encode()).digest()
            out[k] = (np.frombuffer((raw * (dim // 32 + 1))[:dim], np.uint8).astype(np.float32) - 127.5) / 127.5
        return out

    return lambda: model


def hashed_vectors(texts: DataFrame, column: str, dim: int) -> DataFrame:
    return encoded(texts, column, hashing(dim))
