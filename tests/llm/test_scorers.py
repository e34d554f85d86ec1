"""The fitted models of operators 1, 5, 8 and 10 against plain-Python scorers, row by row."""

import math
import re

import numpy as np
import pytest
from fixtures import EDGES, SF
from curves import auc

from passagemill.llm import common, langid, quality, queries, rules, toxicity, windows

SF1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs + [(9000 + k, r[1], r[2]) for k, r in enumerate(EDGES)], labels


def grams(text, sizes, bits):
    """(first byte, bucket) of every n-gram of ``text`` that lies in one word, edges included."""
    for i in range(len(text)):
        h = text[i]
        for n in range(2, sizes.stop):
            if i + n > len(text):
                break
            h = (h * 0x01000193 + text[i + n - 1]) % (1 << 32)
            inner, ends = text[i + 1 : i + n - 1], (text[i], text[i + n - 1])
            if n in sizes and 32 not in inner and not (n == 2 and ends == (32, 32)):
                yield i, ((h ^ (h >> 15)) * (0x9E3779B1 + 2 * n) % (1 << 32)) >> (32 - bits)


def test_language_scores(rows):
    model = langid.train([(t, k) for _, t, k in rows[0] if k])
    for _, t, _ in rows[0][-60:]:
        (lang,), (score,) = model.predict([t])
        if t is None or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0)
            continue
        found = [b for _, b in grams(common.normal_bytes(t[:4000]), langid.SIZES, langid.BITS)]
        if len(t) > 4000:  # the plain scorer is slow
            continue
        z = (model.logits[found].astype(float).sum(axis=0) / max(1, len(found)) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_quality_scores(rows):
    docs, labels = rows
    model = quality.train([(t, labels[i]["quality"]) for i, t, _ in docs if i in labels])
    weights = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))
    number = lambda token: int(windows.hash_words(token, quality.CLASSES)[1][0])
    for (_, t, _), score in zip(docs, model.score([t for _, t, _ in docs]), strict=True):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|_+|[^0-9A-Za-z\x80-\xff_\x09-\x0d\x1c-\x20]+", (t or "").encode())
        found = {number(x) for x in tokens[:50_000]}
        if len(tokens) > 50_000:
            continue
        for a, b in zip(tokens, tokens[1:]):
            found.add(int(windows._mix(np.array([number(a)], np.uint64) * windows._ODD1 + np.uint64(number(b)))[0]))
            if a == b and re.match(rb"[0-9A-Za-z\x80-\xff]", a):
                found.add(1)
        lines = [x for x in (t or "").encode().split(b"\n") if x.strip()]
        found |= {2} if len(set(lines)) < len(lines) else set()
        z = model.bias + sum(weights.get(x, 0.0) for x in found)
        assert abs(score - 1 / (1 + math.exp(-min(40, max(-40, model.slope * z + model.offset))))) < 1e-6


def test_quality_keeps_every_ngram_of_three_rows():
    rng = np.random.default_rng(3)
    own = [" ".join(f"w{k}x{j}" for j in range(400)) for k in range(300)]
    rows = [(f"{'good' if i % 2 else 'bad'} {own[i % 300]}", i % 2) for i in rng.permutation(1800)]
    model = quality.train(rows)
    assert len(model.names) > 200_000 - 2  # beyond the former cap


def test_toxicity_scores(rows):
    docs, labels = rows
    model = toxicity.train([(t, labels[i]["toxic"]) for i, t, _ in docs if i in labels])
    scores = model.score([t for _, t, _ in docs])
    for (_, t, _), score in zip(docs, scores, strict=True):
        if t and len(t) > 4000:
            continue
        text, z = common.normal_bytes(t or "", digits=True), []
        starts = [m.start() - 1 for m in re.finditer(rb"[^ ]+", text)]
        found = list(grams(text, toxicity.SIZES, toxicity.BITS))
        for a, b in zip(starts, [*starts[1:], len(text)]):
            own = [model.logits[k] for i, k in found if a <= i < b]
            z.append(float(np.sum(own, dtype=float)) / max(1, len(own)) + model.bias)
        first = max(z, default=toxicity.LOWEST)
        second = max((x for x in z if x < first - 1e-6), default=toxicity.LOWEST)
        want = 1 / (1 + math.exp(-min(40, max(-40, model.slope * (first + max(0, second)) + model.offset))))
        assert abs(score - want) < 2e-3


def test_verdicts_of_the_learned_rules(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text")
    found = rules.fit(docs, spark.read.parquet(f"{SF1}/labels.parquet"))
    assert found
    shares = {r["doc_id"]: r.asDict() for r in rules.statistics(docs).collect()}
    for r in rules.judge(docs, found).collect():
        s = shares[r["doc_id"]]
        fired = next((k + 1 for k, x in enumerate(found) if x.covers(s)), None)
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        assert (r["rule"], r["base_failed"], r["kept"]) == (fired, failed, not failed and fired is None)


@pytest.mark.parametrize("query, label, least", [("op5_quality_nbsvm", "quality", (0.97, 0.85, 0.95)), ("op8_toxicity", "toxic", (0.9, 0.8, 0.7))])
def test_auc_precision_and_recall_on_held_out_rows(spark, query, label, least):
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    out = queries.QUERIES[query](spark, SF1).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    hits = sum(r["predicted"] and r[label] for r in out)
    got = auc([(r["score"], r[label]) for r in out]), hits / max(1, sum(r["predicted"] for r in out)), hits / sum(r[label] for r in out)
    assert all(a >= b for a, b in zip(got, least, strict=True)), got
