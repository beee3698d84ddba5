"""Embedding providers. Without models the offline stand-in hashes words into signed components and scales to unit length."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.session import nonempty

# Known models and their dimensions.
MODELS = {"all-MiniLM-L6-v2": 384, "all-mpnet-base-v2": 768, "paraphrase-multilingual-MiniLM-L12-v2": 384}
_WORD = re.compile(r"\w+")


def hashed(texts: list[str], dimension: int = 384) -> np.ndarray:
    out = np.zeros((len(texts), dimension))
    for k, t in enumerate(texts):
        for w in _WORD.findall(t.lower()):
            h = xxhash.xxh3_64_intdigest(w)
            out[k, h % dimension] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed_texts(df: DataFrame, key: str, text: str = "text", provider: Callable[[list[str]], np.ndarray] = hashed, batch: int = 32) -> DataFrame:
    """(key, embedding): texts in batches through a provider that is loaded once per worker. Null texts are left out."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(provider(part[text].tolist()))})

    return df.filter(df[text].isNotNull()).select(key, text).mapInPandas(run, f"{key} long, embedding array<double>")


def generate(df: DataFrame, key: str, text: str = "text", model: str = "all-MiniLM-L6-v2", provider: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(key, text, embedding, model, dimension): the texts of a table with the embeddings of a known model (384 components for others); offline the stand-in of its dimension."""
    dimension = MODELS.get(model, 384)
    made = embed_texts(df, key, text, provider or (lambda texts: hashed(texts, dimension)))
    return df.select(key, text).join(made, key).select(key, text, "embedding", F.lit(model).alias("model"), F.lit(dimension).alias("dimension"))


def document_embeddings(df: DataFrame, provider: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """(doc_id, embedding): the unweighted mean of the embeddings of a document's chunks. The mean is taken where the chunks are, so nothing is shuffled."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, provider(list(c)).mean(axis=0)) for d, c in zip(b["doc_id"], b["chunks"]) if c is not None and len(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "embedding"])

    return df.select("doc_id", "chunks").mapInPandas(run, "doc_id long, embedding array<double>")
