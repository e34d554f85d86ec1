"""Vector expressions over arrays of float or double, and the same over blocks of vectors in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a, b) -> Column:
    """Inner product in double precision, in index order; null if either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that have it, and these as a matrix of doubles. Those that are null, or have a null within, are left out."""
    lists = vectors.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64())
    ends = np.cumsum(sizes)
    bad = np.asarray(lists.is_null())
    if flat.null_count:
        bad[np.searchsorted(ends, np.flatnonzero(flat.is_null()), side="right")] = True
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[~bad]):
        at = np.flatnonzero(~bad & (sizes == size))
        out[int(size)] = at, values[(ends[at] - size)[:, None] + np.arange(size)]
    return out


#: Vectors of each side that are multiplied at once, so that sums and products stay in the cache.
CELL = (16, 8192)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices; each is summed in index order, so it equals that of ``dot`` in every bit."""
    out = np.zeros((len(a), len(b)))
    across = np.ascontiguousarray(b.T)
    held = np.empty(CELL)
    with np.errstate(all="ignore"):
        for i in range(0, len(a), CELL[0]):
            for j in range(0, len(b), CELL[1]):
                left, right = a[i : i + CELL[0]], across[:, j : j + CELL[1]]
                product, sums = held[: len(left), : right.shape[1]], np.zeros((len(left), right.shape[1]))
                for d in range(a.shape[1]):
                    np.multiply(left[:, d, None], right[d], out=product)
                    sums += product
                out[i : i + CELL[0], j : j + CELL[1]] = sums
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds; numbers too large to have such digits stay as they are, and zero has no sign."""
    with np.errstate(all="ignore"):
        scaled = x * 10.0**digits
        whole = np.rint(scaled)
        half = np.abs(scaled - np.trunc(scaled)) == 0.5
        whole[half] = np.trunc(scaled[half]) + np.sign(scaled[half])
        return np.where(np.abs(scaled) < 2.0**52, whole / 10.0**digits, x) + 0.0


def masked_mean(vectors, mask) -> Column:
    """Mean over tokens (array of vectors) of those whose mask is 1; null if none is."""
    chosen = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())

    def mean(c: Column) -> Column:
        add = lambda acc, v: F.zip_with(acc, v, lambda s, y: s + y.cast("double"))
        first = F.transform(c[0], lambda y: y.cast("double"))
        return F.when(F.size(c) > 0, F.aggregate(F.slice(c, 2, F.size(c)), first, add, lambda s: F.transform(s, lambda x: x / F.size(c))))

    return let(chosen, mean)


def dcg(rank: Column, k: Column) -> Column:
    """DCG at k where the only relevant row has this rank (null: none); it is the nDCG too."""
    return F.when(rank <= k, 1 / F.log2(rank + 1.0)).otherwise(0.0)


def recall(rank: Column, k: Column) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def dcg_of(relevance) -> Column:
    """The general sum over a list of relevance grades in rank order."""
    gains = F.transform(relevance, lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + F.lit(2.0)))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
