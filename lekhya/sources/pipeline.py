"""The whole way of scanned pages into the store: assembled, cleaned, extracted from, embedded."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.functions import text as T
from lekhya.operators import embed, ner
from lekhya.session import materialise
from lekhya.sources import ocr


class Processed(NamedTuple):
    documents: DataFrame
    entities: DataFrame
    vectors: DataFrame


def process(pages: DataFrame, key: str = "doc_id", embedder: Callable[[list[str]], np.ndarray] = embed.hashed, use_transformers: bool = False) -> Processed:
    """documents (key, text, word_count, char_count, avg_confidence, total_pages), their entities, and (key, embedding) of the whole texts.

    The cleaned texts are written once, since all three parts need them.
    """
    whole = ocr.assemble(pages, key).select(key, T.clean(F.col("full_text")).alias("text"), "avg_confidence", "total_pages")
    texts = materialise(whole, "cleaned")
    documents = texts.select(key, "text", T.word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), "avg_confidence", "total_pages")
    return Processed(documents, ner.extract_entities(texts.select(key, "text"), use_transformers=use_transformers), embed.embed_texts(texts, key, provider=embedder))
