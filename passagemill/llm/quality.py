"""Operator 5, quality classifier: naive Bayes support vectors.

Indicators of token unigrams and bigrams (plus an indicator for a token followed by
itself and one for a line that occurs before) are scaled by the log-count ratio of the
classes; a linear hinge-loss model over them is fitted by dual coordinate descent and
calibrated by a logistic fit on rows that it has not seen.

Edge cases: null and empty texts have no indicator and get the score of the bias alone;
with one label class only, every score is that class's smoothed rate. Repeated rows get
equal results; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: Tokens are runs of letters and digits (and all bytes above ASCII), of underscores, or of other marks.
CLASSES = np.array([0 if c in b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " else 1 if c >= 128 or chr(c).isalnum() else 2 if c == 95 else 3 for c in range(256)], np.uint8)
#: Indicators of a token followed by itself, and of a line that occurs before.
REPEAT, LINE = np.uint64(1), np.uint64(2)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit number) of the tokens and pairs of tokens of whole texts, and of the two repeat marks; not distinct."""
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    joined = b"\n".join(texts)
    starts, h, _ = windows.hash_words(joined, CLASSES)
    if len(starts):
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        inside = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = windows._mix(h[inside] * windows._ODD1 + h[inside + 1])
        again = inside[(h[inside] == h[inside + 1]) & (CLASSES[np.frombuffer(joined, np.uint8)[starts[inside]]] == 1)]
        docs += [doc, doc[inside], doc[again]]
        found += [h, pairs, np.full(len(again), REPEAT)]
    lines = ([x for x in t.split(b"\n") if x.strip()] for t in texts)
    twice = np.flatnonzero([len({*x}) < len(x) for x in lines])
    return np.concatenate([*docs, twice]), np.concatenate([*found, np.full(len(twice), LINE)])


@dataclass
class QualityModel:
    names: np.ndarray  # numbers of the indicators, ascending
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    rate: float | None = None

    def known(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, place in names) of the distinct known indicators of each text, in order, a run of texts at a time."""
        for a, b in common.chunks(texts):
            doc, found = features(texts[a:b])
            at = np.minimum(np.searchsorted(self.names, found), len(self.names) - 1)
            ok = self.names[at] == found if len(self.names) else np.zeros(len(found), bool)
            both = np.unique((doc[ok] + a) * len(self.names) + at[ok])
            yield both // max(1, len(self.names)), both % max(1, len(self.names))

    def raw(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for doc, at in self.known([(t or "").encode("utf-8", "replace") for t in texts]):
            z += np.bincount(doc, self.weights[at], minlength=len(texts))
        return z

    def score(self, texts) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(texts), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.offset, -40, 40)))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM in the dual: one coordinate a row, box 0..cost, weights kept up to date.

    rows: the indicator columns of each row; values: the scale of each column. The bias is a column of 1.
    """
    w, bias = np.zeros(len(values)), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(y > 0, 1.0, -1.0)
    own = [values[r] for r in rows]
    square = np.array([float(v @ v) + 1.0 for v in own])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (float(w[rows[i]] @ own[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                moved = max(moved, abs(new - alpha[i]) * square[i] ** 0.5)
                w[rows[i]] += step * own[i]
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * values, bias


def train(rows: list[tuple[str, int]], least: int = 3, cost: float = 1.0) -> QualityModel:
    """rows: (text, 0 or 1). least: rows that must hold an n-gram; all such n-grams are kept."""
    y = np.array([int(v) for _, v in rows], dtype=np.int64)
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not len(y) or y.min() == y.max():
        return QualityModel(*none, 0.0, 1.0, 0.0, rate=float((y.sum() + 1) / (len(y) + 2)))
    fit = np.array([i % 5 != 0 for i in range(len(rows))]) | (len(rows) < 50)
    texts = [(t or "").encode("utf-8", "replace") for t, _ in rows]
    seen = [none[0]]
    for a, b in common.chunks(texts):
        doc, found = features(texts[a:b])
        order = np.lexsort((found, doc))
        doc, found = doc[order], found[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])][: len(doc)]
        seen.append(found[new & fit[a + doc]])
    names, counts = np.unique(np.concatenate(seen), return_counts=True)
    model = QualityModel(names[counts >= least], none[1], 0.0, 1.0, 0.0)
    doc, at = (np.concatenate(x) for x in zip(*model.known(texts), strict=True))
    columns = np.split(at, np.searchsorted(doc, np.arange(1, len(rows))))
    of_good = np.bincount(at[fit[doc] & (y[doc] == 1)], minlength=len(model.names)) + 1.0
    of_bad = np.bincount(at[fit[doc] & (y[doc] == 0)], minlength=len(model.names)) + 1.0
    n1, n0 = y[fit].sum() + 2, (1 - y[fit]).sum() + 2
    ratio = np.log(of_good / n1) - np.log(of_bad / n0)
    chosen = np.flatnonzero(fit)
    balance = np.where(y[chosen] == 1, 1.0, min(5.0, n1 / n0)) * cost
    model.weights, model.bias = dual_descent([columns[i] for i in chosen], ratio, y[chosen], balance)
    held = np.flatnonzero(~fit) if len({*y[~fit]}) == 2 else chosen
    z = np.array([model.bias + model.weights[columns[i]].sum() for i in held])
    used = model.weights != 0
    model.names, model.weights = model.names[used], model.weights[used]
    model.slope, model.offset = common.platt(z, y[held])
    return model


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4_000) -> QualityModel:
    """Learns from at most ``max_docs`` labelled rows and about 256 MB of text (the documented bounds), whole texts."""
    model = train(common.labelled_sample(docs, labels, "quality", max_docs))
    common.give_back()
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.select("doc_id", rate("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
