"""Embedding texts with a pluggable provider, and keeping a table of vectors.

A provider is made once in each Python worker and is given the texts of an Arrow batch in portions. Providers that need a
model or a service take it as a callable; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.operators.retrieval import missing_vectors, token_slot
from lawloom.session import materialize


class EmbeddingProvider(Protocol):
    """Unit vectors of texts; ``query`` tells a question from a passage."""

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]: ...


def _unit(rows: np.ndarray) -> list[list[float]]:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norm > 0, norm, 1)).tolist()


class HashedTokens:
    """Signed counts of blank-separated small tokens; needs no model."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, t in zip(out, texts):
            for token in t.lower().split():
                slot, sign = token_slot(token, self.dimensions)
                row[slot] += sign
        return _unit(out)


class PrefixedModel:
    """A model that tells questions from passages by a prefix of the text. ``load`` gives a function from texts to vectors."""

    # The prefixes.
    QUERY, PASSAGE = "query: ", "passage: "

    def __init__(self, load: Callable[[], Callable[[list[str]], object]], prefixed: bool = True):
        self.encode, self.prefixed = load(), prefixed

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        prefix = (self.QUERY if query else self.PASSAGE) if self.prefixed else ""
        return _unit(np.asarray(self.encode([prefix + t for t in texts]), float))


class RemoteAnswers:
    """A service whose answer is a list of items with index and embedding, in any order; raises if one is missing."""

    def __init__(self, ask: Callable[[list[str]], list[dict]]):
        self.ask = ask

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        items = sorted(self.ask(texts), key=lambda x: x["index"])
        if len(items) != len(texts):
            raise ValueError(f"{len(items)} vectors for {len(texts)} texts")
        return _unit(np.array([x["embedding"] for x in items], float))


#: Providers by the name a configuration gives.
PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {"hash": HashedTokens, "model": PrefixedModel, "remote": RemoteAnswers}


def provider_from(config: dict) -> Callable[[], EmbeddingProvider]:
    """A maker of the provider a configuration names (``provider``, "hash" by default; its other entries are arguments)."""
    name = config.get("provider", "hash")
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}")
    rest = {k: v for k, v in config.items() if k != "provider"}
    return lambda: PROVIDERS[name](**rest)


def embedded(rows: DataFrame, text_col: str, make: Callable[[], EmbeddingProvider], query: bool = False, portion: int = 32) -> DataFrame:
    """``rows`` with a column embedding: the vector of ``text_col``, null for null. Rows are embedded where they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            vectors: list[list[float] | None] = [None] * len(pdf)
            given = [i for i, t in enumerate(pdf[text_col]) if isinstance(t, str)]
            for at in range(0, len(given), portion):
                part = given[at : at + portion]
                for i, v in zip(part, provider.embed([pdf[text_col].iloc[i] for i in part], query)):
                    vectors[i] = v
            yield pdf.assign(embedding=vectors)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{types}, embedding array<double>")


def append_vectors(chunks: DataFrame, stored: DataFrame, make: Callable[[], EmbeddingProvider], dimensions: int | None = None) -> DataFrame:
    """The table of vectors (point_id, chunk_id, embedding) after the chunks (chunk_id, text) not in it yet were embedded and
    appended; a chunk given twice enters once. Only the missing ones are embedded."""
    new = embedded(missing_vectors(chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]), stored, dimensions), "text", make)
    return stored.select("point_id", "chunk_id", "embedding").unionByName(materialize(new.select("point_id", "chunk_id", F.col("embedding")), "vectors"))
