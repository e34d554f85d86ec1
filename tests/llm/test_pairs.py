"""Operators 2 and 9 against brute force."""

import math
import time
from collections import defaultdict

import numpy as np
import oracle
import pytest
from fixtures import SF, edge_docs, empty_docs
from pyspark.sql import functions as F

from passagemill.llm import common, minhash, queries, vectors


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)


def brute_links(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    s, n = Sets(len(rows)), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    s.join(a, b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[s.root(k)] = min(low.get(s.root(k), i), i)
    return sorted((str(i), n[k], str(low.get(s.root(k)) if i is not None else None), i is not None and low[s.root(k)] == i) for k, (i, _) in enumerate(rows))


def found_links(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


@pytest.mark.parametrize("few", [0, 50_000])
def test_links_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "PART", 40)  # buckets are split
    monkeypatch.setattr(vectors, "FEW_BUCKETS", few)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        centre = rng.standard_normal(24)
        for _ in range(18):
            v = centre + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.25, 0.3])
            rows.append((len(rows), (v * rng.choice([1e-3, 1, 1e5])).tolist()))
    rows += [(1000 + k, rows[k][1]) for k in range(5)] + [(1000, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0] * 23 + [None]), (2004, [1.0] * 23 + [float("nan")]), (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[0][1])]
    t = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(i) for i, c in enumerate(["label", "e", "k1", "k2", "rep", "n", "band", "key", "salt", "m", "code"])})
    assert found_links(vectors.link(t)) == brute_links(rows)


def test_links_of_nothing(spark):
    t = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vectors.link(t).count() == 0


def test_op2_equals_sql(spark):
    oracle.same(queries.op2_embedding_near_dedup(spark, SF), oracle.duck(SF), queries.ORACLE["op2_embedding_near_dedup"])


def test_estimate_is_unbiased_within_its_bound():
    rng = np.random.default_rng(3)
    dim, hits, errors = 64, 0, []
    for seed in range(60):
        turn = vectors.rotations(dim, 1, seed)
        x, q = (v / np.linalg.norm(v) for v in rng.standard_normal((2, dim)))
        codes, factor, _ = vectors.encode(x[None], turn, 8, 8)
        signs = np.where(codes[0], 1, -1) / math.sqrt(dim)
        error = signs @ (turn @ q) / factor[0] - x @ q
        errors.append(error)
        hits += abs(error) <= 5 * math.sqrt((1 - factor[0] ** 2) / factor[0] ** 2 / (dim - 1))
    assert hits == 60 and abs(np.mean(errors)) < 4 * np.std(errors) / math.sqrt(60)


def jaccard(a, b):
    def grams(t):
        w = t.replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def brute_classes(rows):
    s = Sets(len(rows))
    fine = [i is not None and t is not None and bool(t.split()) for i, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and (rows[a][0] == rows[b][0] or rows[a][1] == rows[b][1] or jaccard(rows[a][1], rows[b][1]) >= 0.8):
                s.join(a, b)
    low = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[s.root(k)] = min(low[s.root(k)], i)
    return sorted((str(i), str(low[s.root(k)] if i is not None else None)) for k, (i, _) in enumerate(rows))


def near_copies(seed, groups=6, each=20, edits=(0, 1, 2, 3, 5)):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = list(rng.choice(words, 120))
        for _ in range(each):
            t = list(base)
            for _ in range(rng.choice(edits)):
                t[rng.integers(len(t))] = f"e{rng.integers(10**6)}"
            rows.append((len(rows) * 3 + 5, " ".join(t)))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("part", [512, 16])
def test_classes_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(minhash, "PART", part)
    rows = near_copies(8)
    t = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("rep", F.lit(1)).withColumn("band", F.lit("x"))
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in minhash.classes(t).collect()) == brute_classes(rows)


def test_classes_of_edge_rows(spark):
    docs = edge_docs(spark)
    out = minhash.classes(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in out.collect()) == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["class_id"]) for r in out.collect())
    assert minhash.classes(empty_docs(spark)).count() == 0
    stay = minhash.keep_one(docs)
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 8, 9, 10]
    assert stay.where("doc_id is null").count() == 1


def test_op9_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op9_minhash_near_dedup(spark, SF).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in out) == brute_classes(rows)


def test_near_dedup_leaves_no_shuffle_files(spark):
    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    minhash.classes(docs)
    before, setting = left(), spark.conf.get(common.FREE)
    minhash.classes(docs)  # what it needs on the way is made now, the result by its reader
    end = time.time() + 10
    while (more := left() - before) and time.time() < end:  # Spark removes them in the background
        time.sleep(0.2)
    assert not more and spark.conf.get(common.FREE) == setting == "false"


def test_signature_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    wa, wb = rng.uniform(0.2, 3, len(values)), rng.uniform(0.2, 3, len(values))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    equal = np.mean([(minhash.darts(values, wa, 200, s) == minhash.darts(values, wb, 200, s)).mean() for s in range(12)])
    assert abs(equal - true) < 4 * math.sqrt(true * (1 - true) / 2400)
    assert abs(minhash.similarity(values, wa, values, wb) - true) < 1e-12


def test_sets_are_those_of_single_texts():
    texts = [b"a b c d e f a b c d e", b"", b"x y", b"a  b\tc\nd e f g"]
    values, weights, cut = minhash.shingle_sets(texts, weights="count")
    names = minhash.dart_sets(values, weights, cut)
    for i, t in enumerate(texts):
        v, w = minhash.shingles(t, weights="count")
        assert np.array_equal(v, values[cut[i] : cut[i + 1]]) and np.array_equal(w, weights[cut[i] : cut[i + 1]])
        assert not len(v) or np.array_equal(minhash.darts(v, w), names[i])
    assert sorted(weights[: cut[1]]) == [1, 1, 1, 1, 1, 2]


def test_wide_sets_have_the_same_signature(monkeypatch):
    rng = np.random.default_rng(4)
    for n, scale in ((700, 1.0), (3000, 2.5), (40, 0.3)):
        values, weights = np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), rng.uniform(0.1, 1, n) * scale
        whole = minhash.darts(values, weights)
        monkeypatch.setattr(minhash, "SLICE", 30)
        assert np.array_equal(minhash.darts(values, weights), whole)
        monkeypatch.setattr(minhash, "SLICE", 1 << 17)


def test_one_id_of_two_texts_keeps_a_defined_one(spark):
    import hashlib

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    low, high = sorted((a, b), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for rows in ([(5, low), (5, high), (5, None)], [(5, None), (5, high), (5, low)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        assert [tuple(r) for r in minhash.keep_one(docs).collect()] == [(5, low)]
