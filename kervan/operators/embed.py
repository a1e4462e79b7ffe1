"""Embedding through a plug-in: batched, order-preserving, the model loaded once per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.operators.models import loaded, model_key

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashing_embedder(dims: int = 64) -> Embedder:
    """Deterministic stand-in model: hashed word counts, unit length."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in t.casefold().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else np.eye(1, dims)[0]).tolist())
        return out

    return embed


def letter_embedder() -> Embedder:
    """Stand-in model that any engine can state: how often each of a to z occurs, and one for the text itself."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        return [[1.0, *(float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz")] for t in texts]

    return embed


def embed_one(text: str, load: Callable[[], Embedder], name: str) -> list[float]:
    """The vector of one text, by the model this process holds."""
    check_texts([text])
    (vector,) = vectors = loaded(model_key(name, load), load)([text])
    check_vectors(vectors, 1)
    return [float(x) for x in vector]


def check_texts(texts: Sequence[str]) -> None:
    """A bare string, a value that is no string, or a blank one raises; the message names its place."""
    if isinstance(texts, str):
        raise TypeError("a sequence of texts is needed, not one text")
    for i, t in enumerate(texts):
        if not isinstance(t, str):
            raise TypeError(f"text {i} is not a string")
        if not t.strip():
            raise ValueError(f"text {i} is blank")


def check_vectors(vectors: Sequence[Sequence[float]], expected: int) -> None:
    """One vector per text, numeric, finite, all of one length."""
    if len(vectors) != expected:
        raise ValueError(f"{expected} vectors expected, {len(vectors)} given")
    if vectors and (len({len(v) for v in vectors}) != 1 or not np.isfinite(np.asarray(vectors, float)).all() or not len(vectors[0])):
        raise ValueError("vectors must be finite, non-empty and of one length")


def embed_column(load: Callable[[], Embedder], name: str):
    """A column function text -> vector; `load` runs once per Python worker. Null texts give null."""
    key = model_key(name, load)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        given = texts.dropna()
        if given.empty:
            return pd.Series([None] * len(texts))
        check_texts(list(given))
        vectors = loaded(key, load)(list(given))
        check_vectors(vectors, len(given))
        return pd.Series([[float(x) for x in v] for v in vectors], index=given.index).reindex(texts.index).astype(object).where(texts.notna(), None)

    return embed


def embed(df: DataFrame, text: str, load: Callable[[], Embedder], name: str) -> DataFrame:
    return df.withColumns({"embedding": embed_column(load, name)(text), "embedding_model": F.lit(name)})
