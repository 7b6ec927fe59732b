"""Extractive summary by a graph of the sentences of a text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"\w+")
DAMPING = 0.15
TURNS = 200
TOLERANCE = 1e-10


def sentences(text: str) -> list[str]:
    return [s for s in (part.strip() for part in _SENTENCE.split(text)) if _WORD.search(s)]


def centrality(parts: list[str]) -> np.ndarray:
    """Stationary weight of each sentence on the graph of cosine similarities; the weights sum to one.

    The graph is never built: with unit rows of words W, a step is
    W (W' x), so a turn costs as much as the text has words, however many
    sentences share one.
    """
    vocabulary: dict[str, int] = {}
    row, col, n = [], [], len(parts)
    for i, part in enumerate(parts):
        for w in _WORD.findall(part.lower()):
            row.append(i)
            col.append(vocabulary.setdefault(w, len(vocabulary)))
    if not n:
        return np.zeros(0)
    row, col = np.array(row), np.array(col)
    pair, tf = np.unique(row * len(vocabulary) + col, return_counts=True)
    row, col = pair // len(vocabulary), pair % len(vocabulary)
    idf = 1 + np.log(n / np.bincount(col, minlength=len(vocabulary)))
    w = tf * idf[col]
    w = w / np.sqrt(np.bincount(row, w * w, minlength=n))[row]

    def step(x):
        words = np.bincount(col, w * x[row], minlength=len(vocabulary))
        return np.bincount(row, w * words[col], minlength=n)

    degree, x = step(np.ones(n)), np.full(n, 1 / n)
    for _ in range(TURNS):
        new = DAMPING / n + (1 - DAMPING) * step(x / degree)
        if np.abs(new - x).sum() < TOLERANCE:
            return new
        x = new
    return x


def summarize_graph(docs: DataFrame, *, k: int = 3) -> DataFrame:
    """The ``k`` most central sentences of each text in text order; ties go to the earlier one.

    NULL texts and texts without a word give NULL. Whole texts are read; a
    text is one row, so memory follows the longest text of a batch.
    """
    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        def one(text):
            parts = sentences(text) if text else []
            best = sorted(np.lexsort((np.arange(len(parts)), -np.round(centrality(parts), 8)))[:k])
            return " ".join(parts[i] for i in best) if parts else None
        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.select("document_id", "org_id", pick("extracted_text").alias("summary"))
