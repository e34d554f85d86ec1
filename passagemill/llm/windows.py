"""Operator 6, substring deduplication over a log-structured fingerprint index.

Documents are dealt to blocks of a few MB in doc_id order. Each block is a batch: its
distinct window fingerprints form one immutable sorted run per bucket of the hash space.
A bucket merge-joins its runs, and those of the history, in block order and answers with
one bit per fingerprint: held by another block. Only windows so marked are verified, by
128-bit fingerprints of their words that the same merge gives to the first block; then
the blocks remove what is covered. So a hot passage costs a bucket one entry a block, whatever its copies, and no
task holds more than one block or one bucket. Empty runs, and answers without a bit, are not
sent, so there are never more of them than windows. Rows without an id are dealt to any block;
an id with more rows than a block has several blocks of one level, and only earlier levels count.

``index_runs`` and ``compact`` make the runs of earlier calls, to be kept as Parquet; given
as ``history``, they let a new batch of documents (with larger ids) be deduplicated
without its predecessors' texts.

Edge cases: null and empty texts have no word and keep the hash of the empty string; rows
with a null doc_id lose nothing and cause nothing to be lost; rows of equal doc_id don't
remove each other's words (only smaller ids do); texts of under 13 words are kept whole;
an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of text of a block, and the most that it grows to in large inputs; bytes of text for each bucket.
BLOCK_BYTES, LARGEST_BLOCK, BUCKET_BYTES = 4 << 20, 32 << 20, 32 << 20
#: Quantiles of doc_id that are computed at once; for more blocks, quantiles of what lies between two of them are.
QUANTILES = 20_000
#: A block's number is its level times this, plus its part of the level.
LEVEL = 1 << 20
ANSWER = "block long, bucket int, bits binary"
RUN = "block long, bucket int, run binary"
_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Class of each byte: words are runs of one class, 0 is between words.
WORDS = (~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])).astype(np.uint8)
_BASES = (np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC3A5C85C97CB3127))
_VALUES = [_mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1000 * (k + 1))) for k in range(2)]
#: Bytes of text that are hashed at once: what is held besides the result doesn't grow with a text.
PIECE = 1 << 18


def _powers(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. PIECE of a base and of its inverse modulo 2^64."""
    up, down = np.full(PIECE + 1, base), np.full(PIECE + 1, np.uint64(pow(int(base), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def hash_words(text: bytes, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes of the words of ``text``, and two independent 64-bit hashes of each.

    A hash is a polynomial of tabled byte values; differences of running sums give it for
    all words of a piece at once. A word that runs over the end of a piece is carried on.
    """
    if not _POWERS:
        _POWERS.extend(map(_powers, _BASES))
    every = np.frombuffer(text, np.uint8)
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    first, far, held = 0, 0, [0, 0]  # the word that is open: where it starts, its bytes and sums so far
    for at in range(0, len(every), PIECE):
        x = every[at : at + PIECE]
        kind = classes[x]
        bounds = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(x)]])
        word = kind[bounds[:-1]] > 0
        starts, ends = bounds[:-1][word], bounds[1:][word]
        values = []
        for k in range(2):
            up, down = _POWERS[k]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[k][x] * up[: len(x)])])
            values.append((sums[ends] - sums[starts]) * down[starts])
        starts = starts + at
        if far:
            goes_on = int(kind[0] == classes[every[first]])
            for k in range(2):
                more = pow(int(_BASES[k]), far, 1 << 64) * int(values[k][0]) if goes_on else 0
                whole = np.array([(held[k] + more) % (1 << 64)], np.uint64)
                values[k] = np.concatenate([whole, values[k][goes_on:]])
            starts = np.concatenate([[first], starts[goes_on:]])
        if kind[-1] and at + len(x) < len(every):  # the last word is open
            first, held = int(starts[-1]), [int(v[-1]) for v in values]
            far = at + len(x) - first
            starts, values = starts[:-1], [v[:-1] for v in values]
        else:
            far = 0
        for out, new in zip(found, (starts, *values), strict=True):
            out.append(new)
    starts, *values = (np.concatenate(x) for x in found)
    return starts, _mix(values[0]), _mix(values[1])


def window_hash(h: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` words; order counts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * odd + h[j : j + n]
    return _mix(out)


class Block:
    """The words and windows of a few documents, in doc_id order."""

    def __init__(self, table: pa.Table, size: int):
        ids, keyed, texts = table["doc_id"].to_numpy(), table["keyed"].to_numpy().astype(bool), table["text"].to_pylist()
        #: the table's rows in the block's order
        self.rows = rows = np.lexsort((ids, ~keyed))
        self.ids = [int(ids[i]) if keyed[i] else None for i in rows]
        self.texts = [texts[i] or b"" for i in rows]
        counts, hashes = np.zeros(len(rows), np.int64), [(np.zeros(0, np.uint64),) * 2]
        for a, b in common.chunks(self.texts):
            starts, h1, h2 = hash_words(b"\n".join(self.texts[a:b]))
            ends = np.cumsum([len(t) + 1 for t in self.texts[a:b]])
            counts[a:b] = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=b - a)
            hashes.append((h1, h2))
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        h1, h2 = (np.concatenate(h) for h in zip(*hashes))
        n = max(0, len(h1) - size + 1)
        doc = np.repeat(np.arange(len(rows)), counts)
        inside = (doc[:n] == doc[len(doc) - n :]) & keyed[rows][doc[:n]] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)
        self.hash = window_hash(h1, size, _ODD1)[self.at]
        self.check = window_hash(h2, size, _ODD2)[self.at]
        #: rank of each window's document; equal ids share a rank
        ranks = np.cumsum([0] + [int(a != b) for a, b in zip(self.ids, self.ids[1:])]) if self.ids else np.zeros(0, np.int64)
        self.rank = ranks[doc[self.at]] if len(self.at) else np.zeros(0, np.int64)
        self.doc = doc


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _cut(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of the buckets that ascending fingerprints are in."""
    if not len(h):
        return []
    of = _bucket(h, buckets)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return [*zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True)]


def _runs(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct 64-bit fingerprints of each bucket that has some (a bucket is a range of hashes)."""
    h = np.sort(h)
    h = h[np.r_[True, h[1:] != h[:-1]][: len(h)]]
    return ((k, h[a:z]) for k, a, z in _cut(h, buckets))


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits that a filter run keeps, ascending as the fingerprints are: where in its bucket each stands."""
    n, low = np.uint64(buckets), np.uint64(0xFFFFFFFF)
    at = ((h >> np.uint64(32)) * n & low) + ((h & low) * n >> np.uint64(32))
    return np.minimum(at, low).astype("<u4")


def _bits(frame: pd.DataFrame, cut: np.ndarray, marked: np.ndarray) -> pd.DataFrame:
    """The answers to this call's blocks in which a bit is set."""
    some = np.add.reduceat(marked, cut[:-1]) if len(cut) > 1 else []
    rows = [(b, k, np.packbits(marked[cut[i] : cut[i + 1]]).tobytes()) for i, (b, k) in enumerate(zip(frame["block"], frame["bucket"], strict=True)) if b >= 0 and some[i]]
    return pd.DataFrame(rows, columns=["block", "bucket", "bits"])


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """Filter step of one bucket: a bit a fingerprint, held by any other block (or the history).

    All runs of the bucket are merged in one stable sort, which takes ascending runs as they are; blocks below 0 are history.
    """
    frame = frame.sort_values("block", kind="stable")
    runs = [np.frombuffer(r, "<u4") for r in frame["run"]]
    cut = np.cumsum([0, *map(len, runs)])
    block = np.repeat(frame["block"].to_numpy(np.int64), np.diff(cut))
    every = np.concatenate(runs)
    order = np.argsort(every, kind="stable")  # equal values stay in block order
    values, owner = every[order], block[order]
    other = (values[1:] == values[:-1]) & (owner[1:] != owner[:-1])
    new = np.r_[True, values[1:] != values[:-1]]
    group = np.cumsum(new) - 1
    mixed = np.zeros(group[-1] + 1, dtype=bool)
    mixed[group[1:][other]] = True
    shared = np.zeros(len(every), dtype=bool)
    shared[order] = mixed[group]
    return _bits(frame, cut, shared)


def _pairs(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """128-bit fingerprints as sortable values."""
    out = np.empty(len(h), dtype=[("h", "<u8"), ("c", "<u8")])
    out["h"], out["c"] = h, c
    return out


def _distinct(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sorted distinct 128-bit fingerprints."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][: len(h)]
    return _pairs(h[new], c[new])


def _first_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """Verification of one bucket: a bit a 128-bit fingerprint, held by an earlier level (or the history)."""
    frame = frame.sort_values("block", kind="stable")
    runs = [np.frombuffer(r, [("h", "<u8"), ("c", "<u8")]) for r in frame["run"]]
    sizes = [len(r) for r in runs]
    every = np.concatenate(runs)
    level = np.repeat(frame["block"].to_numpy(np.int64) // LEVEL, sizes)
    order = np.lexsort((level, every["c"], every["h"]))
    h, c, level = every["h"][order], every["c"][order], level[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    seen = np.zeros(len(every), dtype=bool)
    seen[order] = level > level[new][np.cumsum(new) - 1]
    return _bits(frame, np.cumsum([0, *sizes]), seen)


def _marked(runs, answers: pd.DataFrame) -> np.ndarray:
    """The values of a block's runs whose bit is set."""
    bits = {int(k): b for k, b in zip(answers["bucket"], answers["bits"], strict=True)}
    parts = [run[np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(run)).astype(bool)] for k, run in runs if k in bits]
    return np.concatenate(parts) if parts else np.zeros(0, runs[0][1].dtype if runs else np.uint64)


def _shared(block: Block, answers: pd.DataFrame, buckets: int) -> list[tuple[int, np.ndarray]]:
    """128-bit runs, by bucket, of the windows that the filter has marked."""
    hashes = _marked(list(_runs(block.hash, buckets)), answers)  # ascending, as buckets are ranges
    if not len(hashes):
        return []
    spot = np.minimum(np.searchsorted(hashes, block.hash), len(hashes) - 1)
    at = np.flatnonzero(hashes[spot] == block.hash)
    pairs = _distinct(block.hash[at], block.check[at])
    return [(k, pairs[a:z]) for k, a, z in _cut(pairs["h"], buckets)]


def _covered(block: Block, outside: np.ndarray, size: int) -> np.ndarray:
    """Which words a window covers that an earlier document of the block, or of ``outside`` (ascending), has too."""
    covered = np.zeros(len(block.doc) + 1, dtype=np.int64)
    if len(block.at):
        order = np.argsort(block.hash, kind="stable")
        same = block.hash[order][1:] == block.hash[order][:-1]
        twice = order[np.r_[False, same] | np.r_[same, False]]
        twice = twice[np.lexsort((block.rank[twice], block.check[twice], block.hash[twice]))]
        h, c, rank = block.hash[twice], block.check[twice], block.rank[twice]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][: len(twice)]
        repeat = np.zeros(len(block.at), dtype=bool)
        repeat[twice] = rank > rank[new][np.cumsum(new) - 1]
        if len(outside):
            spot = np.searchsorted(outside["h"], block.hash)
            left = np.arange(len(spot))
            while len(left):  # one round, but for equal 64-bit hashes of different words
                left = left[spot[left] < len(outside)]
                left = left[outside["h"][spot[left]] == block.hash[left]]
                hit = outside["c"][spot[left]] == block.check[left]
                repeat[left[hit]] = True
                left = left[~hit]
                spot[left] += 1
        at = block.at[repeat]
        covered[at] += 1
        covered[at + size] -= 1
    return np.cumsum(covered)[:-1] > 0


def _run_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    block, bucket, run = zip(*rows) if rows else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "run": pa.array(run, pa.binary())})


def _quantiles(ids: DataFrame, blocks: int) -> np.ndarray:
    """The doc_ids at which blocks of about equally many rows end, the last left out; ascending, with repeats."""
    cut = lambda n: F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], 10 * max(1000, n)).alias("q")
    coarse = min(blocks, QUANTILES)
    if coarse < 2:
        return np.zeros(0, np.int64)
    first = np.array(ids.agg(cut(coarse)).first()["q"] or [], dtype=np.int64)
    fine = -(-blocks // coarse)
    if fine < 2 or not len(first):
        return first

    @F.pandas_udf("long")
    def between(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(first, ids.to_numpy(np.int64), side="left"))

    more = ids.groupBy(between("doc_id").alias("c")).agg(cut(fine)).collect()  # a row for each of the first quantiles
    return np.sort(np.concatenate([first, *(np.array(r["q"] or [], dtype=np.int64) for r in more)]))


def deal(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: list[str] = ()) -> tuple[DataFrame, int, int]:
    """Documents with a block number that never falls as doc_id grows; the numbers of blocks and of buckets.

    Only quantiles of doc_id reach the driver: 8 bytes for each block, of 32 MB in large
    inputs. carry: columns that go along as the struct ``row``.
    """
    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    blocks = -(-total // min(max(block_bytes, total // QUANTILES), max(block_bytes, LARGEST_BLOCK)))
    blocks = int(max(blocks, min(parts, -(-total // (block_bytes // 16))))) or 1
    cuts = _quantiles(docs.where("doc_id is not null").select(key.alias("doc_id")), blocks)
    # an id that is several quantiles has a level of its own, and as many parts
    ids, counts = np.unique(cuts, return_counts=True)
    hot = {int(i): int(n) for i, n in zip(ids[counts > 1], counts[counts > 1], strict=True)}
    cuts = np.unique(np.concatenate([ids, np.array([*hot], np.int64) - 1])) if hot else ids
    parted = np.zeros(len(cuts) + 1, np.int64)
    for i, n in hot.items():
        parted[np.searchsorted(cuts, i)] = n

    @F.pandas_udf("long")
    def number(ids: pd.Series, spread: pd.Series) -> pd.Series:
        level = np.searchsorted(cuts, ids.to_numpy(np.int64), side="left")
        return pd.Series(level * LEVEL + spread.to_numpy(np.int64) % np.maximum(1, parted[level]))

    given = F.col("doc_id").cast("long")
    spread = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(LEVEL))
    # no null goes to Python as an integer: ids without a value are known by their flag
    block = F.when(given.isNotNull(), number(key, spread)).otherwise(F.pmod(spread, F.lit(len(cuts) + 1)) * LEVEL)
    dealt = docs.select(block.alias("block"), key.alias("doc_id"), F.col("doc_id").isNotNull().alias("keyed"), F.col("text").cast("binary").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
    dealt = dealt.repartition(parts, "block")
    return dealt, blocks, int(max(parts, -(-total // BUCKET_BYTES)))


def mark(docs: DataFrame, size: int = 13, history: DataFrame | None = None, carry: list[str] = ()) -> tuple[DataFrame, DataFrame, int]:
    """(dealt documents, verified answers, buckets): the answers name windows that an earlier block holds."""
    dealt, _, buckets = deal(docs, carry=carry)

    def runs(key, table):
        return _run_table([(key[0].as_py(), k, _short(r, buckets).tobytes()) for k, r in _runs(Block(table, size).hash, buckets)])

    filters = dealt.groupBy("block").applyInArrow(runs, RUN)
    if history is not None:
        filters = filters.union(_history_runs(history, buckets, short=True))
    likely = filters.groupBy("bucket").applyInPandas(_answers, ANSWER)

    def exact(key, table, answers):
        if not table.num_rows:
            return _run_table([])
        return _run_table([(key[0].as_py(), k, r.tobytes()) for k, r in _shared(Block(table, size), answers.to_pandas(), buckets)])

    full = dealt.groupBy("block").cogroup(likely.groupBy("block")).applyInArrow(exact, RUN)
    if history is not None:
        full = full.union(_history_runs(history, buckets, short=False))
    sizes = full.groupBy("bucket").applyInPandas(_first_blocks, ANSWER)
    return dealt, (likely.withColumn("step", F.lit(0)).union(sizes.withColumn("step", F.lit(1)))), buckets


def _removals(docs: DataFrame, size: int, history: DataFrame | None, make, schema: T.StructType, carry: list[str] = ()) -> DataFrame:
    """make(table, block, [(words, which are gone)]) of each block, in the block's order."""
    dealt, answers, buckets = mark(docs, size, history, carry)

    def apply(table, answers):
        frame = answers.to_pandas()
        block = Block(table, size)
        shared = _shared(block, frame[frame["step"] == 0], buckets)
        outside = _marked(shared, frame[frame["step"] == 1]) if shared else np.zeros(0)
        gone = _covered(block, outside, size)
        return make(table, block, ((text.split(), gone[block.first[i] : block.first[i + 1]]) for i, text in enumerate(block.texts)))

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, schema)


def _kept(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)


def remove_repeats(docs: DataFrame, size: int = 13, history: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by a space)."""

    def digest(table: pa.Table, block: Block, texts) -> pa.Table:
        rows = [(len(words), int(gone.sum()), hashlib.sha256(_kept(words, gone)).hexdigest()) for words, gone in texts]
        n, removed, digests = zip(*rows) if rows else ((), (), ())
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    columns = [("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
    return _removals(docs, size, history, digest, T.StructType([T.StructField(*c) for c in columns]))


def deduplicated(docs: DataFrame, size: int = 13, history: DataFrame | None = None) -> DataFrame:
    """The documents without their repeated windows; columns as given.

    A text that loses nothing stays as it is (so does a null); of others the kept words are
    joined by spaces and n_chars, if there is one, follows. A text may become empty; its row stays.
    """
    carry = [c for c in docs.columns if c != "text"]

    def rewrite(table: pa.Table, block: Block, texts) -> pa.Table:
        new = [_kept(words, gone).decode("utf-8", "replace") if gone.any() else None for words, gone in texts]
        order = pa.array(block.rows)
        old = [t if t is None else t.decode("utf-8", "replace") for t in table["text"].take(order).to_pylist()]
        return pa.table({"row": table["row"].take(order), "old": pa.array(old, pa.string()), "new": pa.array(new, pa.string())})

    row = T.StructField("row", T.StructType([docs.schema[c] for c in carry]))
    out = _removals(docs, size, history, rewrite, T.StructType([row, T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]), carry)
    made = {"text": F.coalesce("new", "old")}
    if "n_chars" in carry:
        made["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select([(made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


# --- the index that outlives a call -----------------------------------------------------------------


def _as_runs(pairs: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(0, k, pairs[a:z].tobytes()) for k, a, z in _cut(pairs["h"], buckets)]


def index_runs(docs: DataFrame, size: int = 13) -> DataFrame:
    """(bucket, run): immutable sorted runs of the 128-bit window fingerprints of ``docs``, to be written as Parquet."""
    dealt, _, buckets = deal(docs)

    def runs(table):
        block = Block(table, size)
        return _run_table(_as_runs(_distinct(block.hash, block.check), buckets)).select(["bucket", "run"])

    return dealt.groupBy("block").applyInArrow(runs, "bucket int, run binary")


def compact(runs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Merges all runs of each bucket into one sorted run of distinct fingerprints; as many buckets as all runs need."""
    total = runs.agg(F.sum(F.octet_length("run").cast("long"))).first()[0] or 0
    buckets = int(max(1, -(-total // bucket_bytes)))

    def again(batches):
        for frame in batches:
            for run in frame["run"]:
                yield _run_table(_as_runs(np.frombuffer(run, [("h", "<u8"), ("c", "<u8")]), buckets)).select(["bucket", "run"]).to_pandas()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([np.frombuffer(r, [("h", "<u8"), ("c", "<u8")]) for r in frame["run"]])
        every = _distinct(every["h"], every["c"])
        return pd.DataFrame([(int(frame["bucket"].iloc[0]), every.tobytes())], columns=["bucket", "run"])

    return runs.select("run").mapInPandas(again, "bucket int, run binary").groupBy("bucket").applyInPandas(merge, "bucket int, run binary")


def _history_runs(history: DataFrame, buckets: int, short: bool) -> DataFrame:
    """The runs of an index as blocks of negative number, dealt to this call's buckets."""

    def again(batches):
        for frame in batches:
            rows = []
            for run in frame["run"]:
                pairs = np.frombuffer(run, [("h", "<u8"), ("c", "<u8")])
                rows += [(-1, k, (_short(pairs["h"][a:z], buckets) if short else pairs[a:z]).tobytes()) for k, a, z in _cut(pairs["h"], buckets)]
            yield pd.DataFrame(rows, columns=["block", "bucket", "run"])

    return history.select("run").mapInPandas(again, "block long, bucket int, run binary")
