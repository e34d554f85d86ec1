"""Embedding of texts: token vectors of a plug-in encoder, pooled by their mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import models


def pooled(vectors: np.ndarray, mask: np.ndarray) -> list[float] | None:
    """Mean of the vectors whose mask is 1; None if none is."""
    chosen = np.asarray(vectors, dtype=float)[np.asarray(mask).astype(bool)]
    return (chosen.sum(axis=0) / len(chosen)).tolist() if len(chosen) else None


def embedded(rows: DataFrame, encoder: models.Embedder, text: str = "chunk", batch: int = 64) -> DataFrame:
    """Adds embedding (array of double; null for a null text). Only pooled vectors leave Python."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if hasattr(encoder, "open"):
            encoder.open()
        for texts in frames:
            out: list = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].tolist()
                pairs = encoder.tokens([t or "" for t in part])
                out += [pooled(v, m) if t is not None else None for t, (v, m) in zip(part, pairs, strict=True)]
            yield pd.Series(out, index=texts.index, dtype=object)

    return rows.withColumn("embedding", F.pandas_udf(run, "array<double>")(text))
