"""Encoding of texts: a pluggable encoder, called once for each distinct text.

An encoder is anything with ``dim`` and ``encode(list of texts) -> list of vectors``; it is pickled
with the function that runs in the Python workers, and called on Arrow batches.  ``HashingEncoder`` needs no model: it counts words in
hashed buckets, so vectors add up over concatenation and SQL can check them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedrion.functions.text import is_blank, stripped


#: The default sentence model.  Fixed value: a published multilingual model of 768 dimensions.
DEFAULT_MODEL = "sentence-transformers/paraphrase-multilingual-mpnet-base-v2"


class Encoder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEncoder:
    """Unit vectors of word counts: a word goes to the bucket of the first two hex digits of its md5."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in text.split(" "):
                if word:
                    row[int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:2], 16) % self.dim] += 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return list(out / np.where(norms > 0, norms, 1))


class SentenceEncoder:
    """A sentence-transformers model, loaded once in each worker (an optional dependency)."""

    def __init__(self, model: str = DEFAULT_MODEL, device: str | None = None, dim: int = 768):
        self.model, self.name, self.device, self.dim, self._loaded = model, model, device, dim, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model, device=self.device)
        return list(self._loaded.encode([t if t.strip() else " " for t in texts], normalize_embeddings=True))


def encoder_named(name: str, dim: int) -> Encoder:
    """The encoder an index names: ``hashing-N``, or a sentence model."""
    return HashingEncoder(dim) if name == f"hashing-{dim}" else SentenceEncoder(name, dim=dim)


def encoded(texts: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Distinct texts with their vectors: ``text``, ``vector``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encoder.encode(list(batch["text"])) if len(batch) else []
            if any(len(v) != encoder.dim for v in vectors):
                raise ValueError(f"the encoder gives vectors of other than {encoder.dim} dimensions")
            yield pd.DataFrame({"text": batch["text"], "vector": [np.asarray(v, np.float32) for v in vectors]})

    return texts.select(F.col(text).alias("text")).filter("text is not null").distinct().mapInPandas(run, "text string, vector array<float>")


def section_embeddings(sections: DataFrame, encoder: Encoder) -> DataFrame:
    """Sections with ``e_local`` and ``e_subtree``: of the stripped texts, null for blank ones."""
    rows = sections.withColumn("__l", stripped(F.col("local_text"))).withColumn("__s", stripped(F.col("subtree_text")))
    both = rows.select(F.col("__l").alias("text")).union(rows.select("__s")).filter("text <> ''")
    vectors = encoded(both, encoder)
    local, subtree = vectors.toDF("__l", "e_local"), vectors.toDF("__s", "e_subtree")
    return rows.join(local, "__l", "left").join(subtree, "__s", "left").drop("__l", "__s")


def text_embeddings(text_nodes: DataFrame, encoder: Encoder) -> DataFrame:
    """Text nodes with ``embedding``: of the texts as they are, null for blank ones."""
    vectors = encoded(text_nodes.filter(~is_blank(F.col("text"))), encoder).toDF("text", "embedding")
    return text_nodes.join(vectors, "text", "left")


def query_embeddings(queries: DataFrame, encoder: Encoder) -> DataFrame:
    """Queries with ``q_emb``; a blank query is encoded as a blank."""
    text = F.when(is_blank(F.col("query")), " ").otherwise(F.col("query"))
    rows = queries.withColumn("__t", text)
    return rows.join(encoded(rows, encoder, "__t").toDF("__t", "q_emb"), "__t", "left").drop("__t")


