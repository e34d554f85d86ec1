"""Operator 8, toxicity.

A bag is a run of BAG words (one: the subwords of a word). The embeddings of its hashed
byte n-grams (3 to 6, word edges included) are averaged and go through a linear softmax; both are trained together.
Labels are per document, so training alternates: the bags of a toxic document that score
highest (4 at most) are its toxic ones; of a clean document the 3 highest and 2 random bags
are learned as clean (documented bounds of training; scores are of all bags). A document's evidence is its highest bag, and the second highest different
one if that is toxic too: one phrase in a long text counts, two words count more than one.

Edge cases: null and empty texts score as the lowest calibrated value, not null; with
one label class only, every score is that class's smoothed rate. Repeated rows get
equal results; other input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZES, BITS, BAG = range(3, 7), 20, 1
LOWEST = -50.0


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, the first byte of each bag, and the text of each bag."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    space = buf == 32
    words = np.flatnonzero(~space & np.r_[True, space[:-1]])
    doc = np.searchsorted(ends, words, side="right")
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(words) else words
    rank = np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))
    at = np.flatnonzero(rank % BAG == 0)
    return buf, words[at] - 1, doc[at]


@dataclass
class ToxicityModel:
    logits: np.ndarray  # by bucket, toxic less clean
    bias: float
    slope: float
    offset: float
    rate: float | None = None

    def bags(self, texts: list[bytes], strongest: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every bag; ``strongest``: of its highest n-gram of each size in place of the mean."""
        docs, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        pieces, of = common.at_spaces(texts)  # a bag is a word, so no bag is cut
        for a, b in common.chunks(pieces):
            buf, starts, doc = _bags(pieces[a:b])
            if not len(starts):
                continue
            total, count = np.zeros(len(buf), np.float32), np.zeros(len(buf), np.int32)
            if strongest:  # one size alone may be another n-gram of the same bucket
                z = np.zeros(len(starts))
                for bucket, ok in common.byte_ngrams(buf, SIZES, BITS):
                    total[:] = 0
                    total[: len(ok)] = np.where(ok, self.logits[bucket], np.float32(0))
                    z += np.maximum.reduceat(total, starts) / len(SIZES)
                docs.append(of[doc + a])
                values.append(z)
                continue
            for bucket, ok in common.byte_ngrams(buf, SIZES, BITS):
                total[: len(ok)] += np.where(ok, self.logits[bucket], np.float32(0))
                count[: len(ok)] += ok
            docs.append(of[doc + a])
            values.append(np.add.reduceat(total, starts, dtype=np.float64) / np.maximum(np.add.reduceat(count, starts), 1) + self.bias)
        return np.concatenate(docs), np.concatenate(values)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """The highest logit of each text, plus the next different one if it is positive; LOWEST without a bag."""
        doc, z = self.bags(texts)
        first, second = np.full(len(texts), LOWEST), np.full(len(texts), LOWEST)
        np.maximum.at(first, doc, z)
        rest = z < first[doc] - 1e-6  # a word that comes again has the same logit
        np.maximum.at(second, doc[rest], z[rest])
        return first + np.maximum(second, 0)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        return self.evidence([common.normal_bytes(t or "", digits=True) for t in texts])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(texts), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.offset, -40, 40)))


def _examples(texts: list[bytes], pick: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of the picked bags of each text."""
    out = []
    for text, ranks in zip(texts, pick, strict=True):
        buf, starts, _ = _bags([text])
        stops = np.r_[starts[1:] + 1, len(buf)]
        for k in ranks:
            part = buf[starts[k] : stops[k]]
            ids, counts = np.unique(np.concatenate([b[ok] for b, ok in common.byte_ngrams(part, SIZES, BITS)] or [np.zeros(0, np.uint32)]), return_counts=True)
            out.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[str, int]], rounds: int = 2, seed: int = 7) -> ToxicityModel:
    """rows: (text, 0 or 1)."""
    y = np.array([int(v) for _, v in rows], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0, rate=float((y.sum() + 1) / (len(y) + 2)))
    texts = [common.normal_bytes(t, digits=True) for t, _ in rows]
    fit = np.array([i % 5 != 0 for i in range(len(rows))]) | (len(rows) < 50)
    seen = np.zeros((2, 1 << BITS), np.float32)
    for text, label in zip([t for t, k in zip(texts, fit, strict=True) if k], y[fit], strict=True):
        grams = [b[ok] for b, ok in common.byte_ngrams(np.frombuffer(text, np.uint8), SIZES, BITS)]
        if grams:
            seen[label, np.unique(np.concatenate(grams))] += 1
    share, both = y[fit].mean(), seen.sum(axis=0)
    excess = ((seen[1] - share * both) / np.sqrt(share * (1 - share) * both + 1)).astype(np.float32)
    model = ToxicityModel(excess, 0.0, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    chosen = np.flatnonzero(fit)
    for step in range(rounds):
        own = [texts[i] for i in chosen]
        doc, z = model.bags(own, strongest=step == 0)
        order = np.argsort(doc, kind="stable")
        doc, z = doc[order], z[order]
        bounds = np.searchsorted(doc, np.arange(len(own) + 1))
        pick, labels = [], []
        for k, i in enumerate(chosen):
            part = z[bounds[k] : bounds[k + 1]]
            if not len(part):
                ranks = np.zeros(0, np.int64)
            elif y[i]:
                top = np.argsort(-part, kind="stable")[:4]
                ranks = top[(part[top] >= 0.5 * part[top[0]]) | (np.arange(len(top)) < 1)] if not step else top[(part[top] > 0) | (np.arange(len(top)) < 1)]
            else:
                ranks = np.unique(np.r_[np.argsort(-part, kind="stable")[:3], rng.integers(0, len(part), 2)])
            pick.append(ranks)
            labels += [int(y[i])] * len(ranks)
        labels = np.array(labels)
        weight = np.where(labels == 1, max(1.0, 0.5 * (labels == 0).sum() / max(1, (labels == 1).sum())) ** 0.5, 1.0)
        logits, bias = common.train_subwords(_examples(own, pick), labels, 2, BITS, dim=8, epochs=4, seed=seed + step, weight=weight)
        model = ToxicityModel((logits[:, 1] - logits[:, 0]).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    held = np.flatnonzero(~fit) if len({*y[~fit]}) == 2 else chosen
    top = model.evidence([texts[i] for i in held])
    real = top > LOWEST
    model.slope, model.offset = common.platt(top[real], y[held][real])
    return model


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 6_000) -> ToxicityModel:
    """Learns from at most ``max_docs`` labelled rows and about 256 MB of text (the documented bounds), whole texts."""
    model = train(common.labelled_sample(docs, labels, "toxic", max_docs))
    common.give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.select("doc_id", rate("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
