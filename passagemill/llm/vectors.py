"""Operator 2, near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors are collapsed first. Every other vector is rotated by random orthogonal
matrices; the signs of its coordinates are its code, and the inner product of code and
vector is the stored correction factor. Bands of code bits bring candidates together. In
a bucket the inner product of each pair is estimated without bias from a code, the other
vector and the factor; pairs whose upper confidence bound is below the threshold are
dropped, all others are computed exactly in double precision. A pair counts in the first
band that it shares, so each link counts once and no pair list is made. Large buckets are
split by salt, and pairs of parts go to different tasks.

A bucket is first met by codes, and by vectors rounded to a byte a component (the rounding
is added to the bound). Whole vectors go only to the buckets where some pair is left.

Band width and number follow from the number of vectors and the threshold: a pair at the
threshold is missed with a probability of at most ``miss``.

Edge cases: null, empty and zero vectors and those with a null or non-finite component
link with nothing (n_links 0, component of their own); vectors of different length don't
link; equal vectors under several ids, and repeated rows, link with each other; a null
vec_id links with nothing and has a null component. Other columns (labels) are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PART = 1024
#: Large buckets that are broadcast at most; more are joined.
FEW_BUCKETS = 50_000
_KEY = ["dim", "band", "key", "i", "j"]
_ROW = "dim int, band int, key long, tid long, code binary, rounded binary, step float, factor float"
_LEFT = "dim int, band int, key long, i long, j long, salt long, tid long, code binary"
_FOUND = "tid long, vec_id long, links long, root long"


def bands_for(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a band, bands): buckets of random vectors hold some 200 vectors."""
    bits = min(40, max(6, math.ceil(math.log2(max(n, 2))) - 8))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random orthogonal matrices, one above the other."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def encode(x: np.ndarray, turn: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits of all rotations (those of the first are the code), correction factors, and the band keys of unit rows ``x``."""
    dim = x.shape[1]
    up = x @ turn.T > 0
    factor = np.abs(x @ turn[:dim].T).sum(axis=1) / math.sqrt(dim)
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    keys = (up[:, : bits * bands].reshape(len(x), bands, bits) * weights).sum(axis=2, dtype=np.uint64)
    return up, factor, keys


def candidates(rotated: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float, sure: float, off: np.ndarray | None = None) -> np.ndarray:
    """Pairs (code row, vector row) whose estimate plus bound reaches the threshold.

    <code, q> / factor estimates <x, q> without bias; its error is within
    sure * sqrt((1 - factor^2) / factor^2 / (dim - 1)) but for a vanishing probability.
    off: how far a component of each vector row may be from that of the vector.
    """
    dim = rotated.shape[1]
    signs = np.where(codes, np.float32(1 / math.sqrt(dim)), np.float32(-1 / math.sqrt(dim)))
    estimate = (signs @ rotated.astype(np.float32).T) / factor[:, None].astype(np.float32)
    bound = sure * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    if off is not None:
        estimate += (math.sqrt(dim) * off[None, :] / factor[:, None]).astype(np.float32)
    return np.argwhere(estimate + bound[:, None].astype(np.float32) >= threshold - 1e-5)


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n rows reaches over the pairs (a, b)."""
    low = ids.copy()
    while len(a):
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        if (low == before).all():
            break
    return low


def link(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-4, sure: float = 5.0, seed: int = 29) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    common.ensure_checkpoint_dir(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fine = F.expr("vec_id is not null and e is not null and not exists(e, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(e, x -> x <> 0)")
    keys = [F.xxhash64("e").alias("k1"), F.xxhash64("e", F.lit(seed)).alias("k2")]
    keyed = rows.select("vec_id", F.coalesce(fine, F.lit(False)).alias("fine"), *keys, "e")
    reps = keyed.where("fine").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("e").alias("e"))
    # a distinct vector has a number of its own, as one vec_id may have several; it is fixed by the checkpoint
    reps = reps.withColumn("tid", F.monotonically_increasing_id()).checkpoint()
    total = reps.count()
    bits, bands = bands_for(total, threshold, miss)
    turned: dict[int, np.ndarray] = {}

    def turn_for(dim: int) -> np.ndarray:
        if dim not in turned:
            turned[dim] = rotations(dim, -(-bits * bands // dim), seed)
        return turned[dim]

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def units(batches):
        for frame in batches:
            frame["dim"] = frame["e"].map(len)
            for dim, part in frame.groupby("dim"):
                for at in range(0, len(part), 1024):
                    few = part.iloc[at : at + 1024]
                    yield int(dim), few["tid"].to_numpy(), unit(np.stack(few["e"].tolist()))

    def keys_of(batches):
        for dim, tid, x in units(batches):
            _, _, keys = encode(x, turn_for(dim), bits, bands)
            yield pd.DataFrame({"dim": dim, "band": np.tile(np.arange(bands), len(x)), "key": keys.astype(np.int64).ravel(), "tid": np.repeat(tid, bands)})

    def emit(batches):
        for dim, tid, x in units(batches):
            up, factor, keys = encode(x, turn_for(dim), bits, bands)
            rotated = x @ turn_for(dim)[:dim].T
            step = np.abs(rotated).max(axis=1) / 127
            rounded = [r.tobytes() for r in np.rint(rotated / step[:, None]).astype(np.int8)]
            code = [c.tobytes() for c in np.packbits(up[:, : max(dim, bits * bands)], axis=1)]
            for band in range(bands):
                yield pd.DataFrame({"dim": dim, "band": band, "key": keys[:, band].astype(np.int64), "tid": tid, "code": code, "rounded": rounded, "step": step.astype(np.float32), "factor": factor.astype(np.float32)})

    bucket = ["dim", "band", "key"]
    found = reps.select("tid", "e").mapInPandas(keys_of, "dim int, band int, key long, tid long").withColumn("salt", common.salt("tid"))
    large = found.groupBy(*bucket).agg(F.count("*").alias("m"), common.salts()).where(F.col("m") > PART).checkpoint()
    coded = reps.select("tid", "e").mapInPandas(emit, _ROW)
    if large.count() <= FEW_BUCKETS:  # a table of known size
        met = coded.join(F.broadcast(large.drop("salts")), bucket, "left")
    else:
        met = coded.withColumn("salt", common.salt("tid")).join(common.by_salt(large), [*bucket, "salt"], "left")
    parts = F.coalesce(F.ceil(F.col("m") / PART), F.lit(1))
    dealt = met.withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("tid"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other")).drop("other", "m", "parts")

    def groups(batches):
        """Each group of a bucket's parts: its number of components, band, rows, and those of part i and of part j."""
        for table in common.whole_groups(batches, _KEY):
            cols = [table[c].to_numpy() for c in _KEY]
            cut = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), len(table)]
            for a, b in zip(cut, cut[1:]):
                if b - a > 1:
                    part = table.slice(a, b - a)
                    salt = part["salt"].to_numpy()
                    yield int(cols[0][a]), int(cols[1][a]), part, np.flatnonzero(salt == cols[3][a]), np.flatnonzero(salt == cols[4][a]), cols[3][a] == cols[4][a]

    def likely(left, right, same, rotated, codes, factor, off=None):
        """Pairs of rows that the estimate leaves, in runs."""
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            pairs = candidates(rotated[right], codes[a], factor[a], threshold, sure, None if off is None else off[right])
            p, q = a[pairs[:, 0]], right[pairs[:, 1]]
            yield (p[p < q], q[p < q]) if same else (p, q)

    def packed(column, rows: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)

    def first_shared(code: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first band whose bits agree."""
        same = code[p, : bits * bands] == code[q, : bits * bands]
        return same.reshape(len(p), bands, bits).all(axis=2).argmax(axis=1)

    def left_over(batches):
        for dim, band, part, left, right, same in groups(batches):
            rows = len(part)
            code = np.unpackbits(packed(part["code"], rows), axis=1).astype(bool)
            step, factor = part["step"].to_numpy(), part["factor"].to_numpy().astype(float)
            rotated = packed(part["rounded"], rows).view(np.int8) * step[:, None]
            some = np.zeros(rows, dtype=bool)
            for p, q in likely(left, right, same, rotated, code[:, :dim], factor, step * 0.5001):
                for k in range(0, len(p), 1 << 16):
                    u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                    first = first_shared(code, u, v) == band
                    some[u[first]] = some[v[first]] = True
            if some.any():
                yield from part.select(["dim", "band", "key", "i", "j", "salt", "tid", "code"]).take(pa.array(np.flatnonzero(some))).to_batches()

    def search(batches):
        for dim, band, part, left, right, same in groups(batches):
            rows = len(part)
            x = unit(part["e"].combine_chunks().flatten().to_numpy().reshape(rows, dim))
            tid, ids, n = (part[c].to_numpy() for c in ("tid", "rep", "n"))
            rotated = x @ turn_for(dim)[:dim].T
            code, factor = np.unpackbits(packed(part["code"], rows), axis=1).astype(bool), np.abs(rotated).sum(axis=1) / math.sqrt(dim)
            links, ends = np.zeros(rows, np.int64), [np.zeros((0, 2), np.int64)]
            for p, q in likely(left, right, same, rotated, code[:, :dim], factor):
                for k in range(0, len(p), 1 << 16):
                    u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                    near = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                    u, v = u[near], v[near]
                    first = first_shared(code, u, v) == band
                    u, v = u[first], v[first]
                    np.add.at(links, u, n[v])
                    np.add.at(links, v, n[u])
                    ends.append(np.stack([u, v], axis=1))
            ends = np.concatenate(ends)
            root = _roots(rows, ends[:, 0], ends[:, 1], ids)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (tid, ids, links, root)], names=["tid", "vec_id", "links", "root"])

    meet = lambda t: t.repartition(*_KEY).sortWithinPartitions(*_KEY, "tid")
    rest = meet(dealt).mapInArrow(left_over, _LEFT).join(reps.select("tid", "rep", "n", "e"), "tid")
    found = meet(rest).mapInArrow(search, _FOUND).checkpoint()
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    parts = common.connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    sums = reps.select("k1", "k2", "tid", "rep", "n").join(links, "tid", "left").join(parts, F.col("rep") == F.col("id"), "left")
    sums = sums.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = keyed.where("fine").select("vec_id", "k1", "k2").join(sums, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = keyed.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.a = c.component_id AS kept FROM c LEFT JOIN n ON c.a = n.a
"""
