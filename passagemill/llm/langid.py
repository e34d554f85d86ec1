"""Operator 1, language identification.

Byte n-grams (2 to 4) of the whole text are hashed to 2^16 buckets; their embeddings
are averaged and go through a linear softmax; both layers are trained together by
stochastic gradient descent. A temperature and a rejection threshold are set on a
calibration share of the training rows that the fit has not seen.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected;
without any labelled row every text is ``und``. Ties go to the language first by code
point. Repeated rows get equal results. Other input columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZES, BITS = range(2, 5), 16
LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Mean logits by text; the work arrays hold those of some 256 KB of text, also of a longer one."""
        pieces, of = common.at_spaces(texts)
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for a, b in common.chunks(pieces):
            buf = np.frombuffer(b"".join(pieces[a:b]), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in pieces[a : b - 1]])]).astype(np.int64)
            for bucket, ok in common.byte_ngrams(buf, SIZES, BITS):
                at = np.flatnonzero(ok)
                piece = np.searchsorted(starts, at, side="right") - 1
                edges = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(at) else at
                if len(at):
                    np.add.at(total, of[a + piece[edges]], np.add.reduceat(self.logits[bucket[at]], edges, axis=0))
                    count += np.bincount(of[a + piece], minlength=len(texts))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            z = self.raw([common.normal_bytes(texts[i]) for i in known]) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                lang[i], score[i] = self.languages[k], s
        return lang, score


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(text, np.uint8)
    ids, counts = np.unique(np.concatenate([b[ok] for b, ok in common.byte_ngrams(buf, SIZES, BITS)] or [np.zeros(0, np.uint32)]), return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def train(rows: list[tuple[str, str]], reject: float = 0.001, seed: int = 3) -> LanguageModel:
    """rows: (text, language). reject: the share of right calibration rows that may be rejected."""
    rows = [(t, y) for t, y in rows if t and y and LETTER.search(t)]
    languages = sorted({y for _, y in rows})
    if not rows:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    fit = [r for i, r in enumerate(rows) if i % 5] or rows
    bags, y = [], []
    for text, lang in fit:  # the document, and each of its lines, so that short texts are known too
        for part in dict.fromkeys([text, *text.split("\n")]):
            if LETTER.search(part):
                bags.append(_bag(common.normal_bytes(part)))
                y.append(languages.index(lang))
    logits, bias = common.train_subwords(bags, np.array(y), len(languages), BITS, epochs=3, seed=seed)
    model = LanguageModel(languages, logits, bias)
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    z, t = model.raw([common.normal_bytes(x) for x, _ in held]), np.array([languages.index(y) for _, y in held])

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(t)), t]).mean())

    model.temperature = min((0.25 * 1.25**k for k in range(20)), key=loss)
    _, score = model.predict([x for x, _ in held])
    model.threshold = min(0.5, float(np.quantile(score, reject)))
    return model


def fit(docs: DataFrame, max_docs: int = 2_000, seed: int = 11) -> LanguageModel:
    """Learns from ``text`` and non-null ``lang`` of at most about ``max_docs`` rows and some 256 MB of text (documented bounds), the same share of each language at most max_docs / languages where there are more."""
    labels = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    counts = {r["lang"]: r["count"] for r in labels.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return train([])
    each = max_docs / len(counts)
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, each / n))])
    mix = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(1_000_000))
    model = train(common.labelled_sample(docs, labels.where(mix < share[F.col("lang")] * 1_000_000), "lang", max_docs, seed=seed))
    common.give_back()
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        lang, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": [k == "und" or s < model.threshold for k, s in zip(lang, score, strict=True)]})

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected", "__lid")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], predict(F.col(text)).alias("__lid")).select(*[F.col(f"`{c}`") for c in kept], "__lid.*")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language is told with enough confidence; columns as given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        lang, score = shared.value.predict(texts.tolist())
        return pd.Series([k != "und" and s >= shared.value.threshold for k, s in zip(lang, score, strict=True)])

    return docs.where(told(F.col("text")))
