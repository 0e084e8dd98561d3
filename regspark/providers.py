"""Pluggable models. Spark partitions the rows; a provider only sees one batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmbeddingProvider(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class TextProvider(Protocol):
    """Answers prompts; an exception's text becomes the error column of its row."""

    def complete(self, prompt: str) -> str: ...


class ScoreProvider(Protocol):
    def score(self, queries: Sequence[str], texts: Sequence[str]) -> Sequence[float]: ...


class HashingEmbedding:
    """Deterministic offline vectors: signed hashing of words and word pairs, unit length."""

    def __init__(self, dim: int = 1024):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", (text or "").lower())
            for token in words + [a + " " + b for a, b in zip(words, words[1:])]:
                h = xxhash.xxh64_intdigest(token)
                out[i, h % self.dim] += 1.0 if (h >> 32) & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class WordOverlapScore:
    """Deterministic offline reranker: share of query words present in the text."""

    def score(self, queries: Sequence[str], texts: Sequence[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts):
            words = set(re.findall(r"\w+", (q or "").lower()))
            out.append(len(words & set(re.findall(r"\w+", (t or "").lower()))) / len(words) if words else 0.0)
        return out


def add_embeddings(df: DataFrame, texts: dict[str, str], provider: EmbeddingProvider) -> DataFrame:
    """One vector column per entry of ``texts`` (vector column -> text column), L2 normalised."""
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.ArrayType(T.FloatType())) for c in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vector, text in texts.items():
                v = np.asarray(provider.embed(pdf[text].fillna("").tolist()), dtype=np.float32)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                pdf[vector] = list(v / np.where(norm == 0, 1, norm))
            yield pdf

    return df.mapInPandas(run, schema)


def add_completions(df: DataFrame, prompts: dict[str, str], provider: TextProvider) -> DataFrame:
    """Answers for one or more prompt columns (answer column -> prompt column) and one ``error`` column."""
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.StringType()) for c in prompts]
                          + [T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers: dict[str, list] = {c: [] for c in prompts}
            errors = []
            for row in pdf[list(prompts.values())].itertuples(index=False):
                error = None
                for (answer, _), prompt in zip(prompts.items(), row):
                    try:
                        answers[answer].append(provider.complete(prompt))
                    except Exception as e:  # the row carries its error, the batch goes on
                        answers[answer].append("")
                        error = error or str(e)
                errors.append(error)
            yield pdf.assign(**answers, error=errors)

    return df.mapInPandas(run, schema)


def score_column(provider: ScoreProvider):
    """Pandas UDF ``(query, text) -> double``."""

    @F.pandas_udf(T.DoubleType())
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(provider.score(query.tolist(), text.tolist()), dtype="float64")

    return score
