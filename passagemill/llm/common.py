"""Pieces shared by the training-data operators: sampling, hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: The word of every contract: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(mod: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % mod, F.lit(-1))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder that the cluster names; makes one only where none is set and Spark is local."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch.base(spark))


#: Spark removes the shuffle files of an action when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Frames that are made within leave no shuffle files after an action; else these stay until the driver collects garbage."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder; the shuffle files of making it go at once."""
    with freed(df.sparkSession):
        return df.select("*").checkpoint()  # a frame of its own, as Spark reads the setting where a frame is made


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chosen_labels(labels: DataFrame, label: str, max_docs: int, seed: int) -> DataFrame:
    """(doc_id, y, mix) of the ``max_docs`` labelled rows of smallest hash of the id: a table of that many rows at most."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    return known.withColumn("mix", F.xxhash64("doc_id", F.lit(seed))).orderBy("mix", "doc_id", "y").limit(max_docs)


def labelled_sample(texts: DataFrame, labels: DataFrame, label: str, max_docs: int, seed: int = 11, max_bytes: int = 256 << 20) -> list[tuple[str, object]]:
    """(text, label) of at most ``max_docs`` rows, chosen by a hash of the id, in hash order.

    Texts are whole, of any length; once those before hold ``max_bytes`` no more are taken.
    Of several texts under one id the first in order is meant. Ids and labels are chosen
    first, so what is broadcast and collected is bounded by both parameters.
    """
    chosen = chosen_labels(labels, label, max_docs, seed)
    found = texts.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("mix", "doc_id", "y").agg(F.min("text").alias("text"))
    above = Window.orderBy("mix", "doc_id", "y").rowsBetween(Window.unboundedPreceding, -1)  # of max_docs rows at most
    kept = one.withColumn("before", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(above), F.lit(0))).where(F.col("before") < max_bytes)
    rows = sorted(kept.select("mix", "doc_id", "y", "text").collect(), key=lambda r: (r["mix"], r["doc_id"], str(r["y"])))
    return [(r["text"], r["y"]) for r in rows]


# --- groups that may be hot -------------------------------------------------------------------------

#: Salts of joins on a key that may be hot (bits of a long).
SPREAD = 64
#: Rows, and bytes, of the groups that a task holds at once; a larger group is held whole.
RUN_ROWS, RUN_BYTES = 20_000, 16 << 20


def salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SPREAD)).cast("int")


def salts():
    """Aggregate: the values of ``salt`` that occur."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def by_salt(t: DataFrame) -> DataFrame:
    """A row for each of the salts."""
    return t.withColumn("salt", F.explode(F.expr(f"filter(sequence(0, {SPREAD - 1}), s -> getbit(salts, s) = 1)"))).drop("salts")


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, of about RUN_ROWS rows or RUN_BYTES, from batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (b.slice(i, step) for b in batches if b.num_rows for step in [max(1, int(b.num_rows * min(1.0, RUN_BYTES / b.nbytes)))] for i in range(0, b.num_rows, step)):
        held.append(batch)
        size += batch.num_rows
        if size < RUN_ROWS and sum(b.nbytes for b in held) < RUN_BYTES:
            continue
        table = pa.Table.from_batches(held)
        last, same = size - 1, np.ones(size, dtype=bool)
        for c in key:
            values = table[c].to_numpy()
            same &= values == values[last]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size -= cut
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Returns to the system what a fit has freed on the driver; nothing where the C library has no such call."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- byte n-grams ---------------------------------------------------------------------------------

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal_bytes(text: str, digits: bool = False) -> bytes:
    """Lower-cased UTF-8; every ASCII byte that is no letter (or digit) becomes a space; framed by spaces."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_ALNUM if digits else _LETTERS) + b" "


def byte_ngrams(buf: np.ndarray, sizes: range, bits: int):
    """For each n: the hash bucket of the n-gram that starts at each byte, and whether it lies in one word.

    A space may only be the first or last byte, so that word edges count and words don't mix.
    """
    x = buf.astype(np.uint32)
    space = buf == 32
    h = x.copy()
    bad = np.zeros(len(buf), dtype=bool)
    for n in range(2, sizes.stop):
        if len(buf) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        bad = bad[:-1] if n == 2 else bad[:-1] | space[n - 2 : len(buf) - 1]
        if n in sizes:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
            ok = ~bad & ~(space[: len(h)] & space[n - 1 :]) if n == 2 else ~bad
            yield mixed >> np.uint32(32 - bits), ok


def chunks(texts: list[bytes], most: int = 1 << 18):
    """Runs of texts of about ``most`` bytes together (a longer text is a run of its own): (first, last)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def at_spaces(texts: list[bytes], most: int = 1 << 18) -> tuple[list[bytes], np.ndarray]:
    """Normal texts in pieces of about ``most`` bytes, and the text that each is of.

    A cut is at a space, which both pieces hold: every n-gram that lies in one word is in one piece.
    """
    pieces, of = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > most:
            cut = t.rfind(b" ", at + 1, at + most)
            cut = cut if cut > 0 else t.find(b" ", at + most)
            if not 0 < cut < len(t) - 1:
                break
            pieces.append(t[at : cut + 1])
            of.append(i)
            at = cut
        pieces.append(t[at:])
        of.append(i)
    return pieces, np.array(of, np.int64)


def train_subwords(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, bits: int, dim: int = 16, epochs: int = 6, rate: float = 0.3, seed: int = 5, weight: np.ndarray | None = None):
    """Joint SGD (adaptive step per row) of bucket embeddings and a linear softmax over their average.

    bags: (buckets, shares that sum to 1) of each example. Returns the product of both
    layers, which is all that a prediction needs: logits by bucket, and the bias.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    seen = np.full(1 << bits, 1e-6, np.float32)
    seen_out = np.full((dim, classes), 1e-6, np.float32)
    seen_bias = np.full(classes, 1e-6, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - 0.8 * epoch / epochs)
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            if not len(ids):
                continue
            rows = emb[ids]
            hidden = share @ rows
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            if weight is not None:
                p *= weight[i]
            if abs(p[y[i]]) < 1e-3:
                continue
            back = out @ p
            g = np.outer(hidden, p)
            seen_out += g * g
            out -= step * g / np.sqrt(seen_out)
            seen_bias += p * p
            bias -= step * p / np.sqrt(seen_bias)
            push = share / share.max()
            seen[ids] += (push * push) * float(back @ back)
            emb[ids] = rows - (step * push / np.sqrt(seen[ids]))[:, None] * back
    return (emb @ out).astype(np.float32), bias


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic fit (with the usual smoothed targets), by Newton steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    scale = max(float(np.abs(z).max(initial=0)), 1e-9)
    u, a, b = z / scale, 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * u).sum() + 1e-6 * a, (p - t).sum()])
        m = np.array([[(w * u * u).sum() + 1e-6, (w * u).sum()], [(w * u).sum(), w.sum()]])
        d = np.linalg.solve(m + 1e-9 * np.eye(2), g)
        size = float(np.abs(d).max())
        d *= min(1.0, 4 / size) if size > 0 else 0
        a, b = a - d[0], b - d[1]
        if size < 1e-7:
            break
    return float(a / scale), float(b)


# --- connected components -------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges(a, b)``: the smallest id that links reach.

    Alternating large-star / small-star steps, until every id hangs on one smaller id that
    hangs on none; every step is checkpointed in the shared folder, so a lost executor costs
    one step, and what it shuffled is freed. Nothing but whether it is done reaches the driver.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)

    def both_ways(pairs: DataFrame, there, back) -> DataFrame:
        return pairs.select(F.inline(F.array(F.struct(*there), F.struct(*back))))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        ends = both_ways(pairs, ["a", "b"], [F.col("b").alias("a"), F.col("a").alias("b")]) if large else pairs
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        both = ends.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k"))
        moved = [F.col("b").alias("a"), F.col("m").alias("b")]
        out = both.where(F.col("b") > F.col("a")).select(*moved) if large else both_ways(both, moved, ["a", F.col("m").alias("b")])
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def done(pairs: DataFrame) -> bool:
        one, none = F.lit(1), F.lit(0)
        ends = both_ways(pairs, [F.col("a").alias("id"), one.alias("up"), none.alias("down")], [F.col("b").alias("id"), none.alias("up"), one.alias("down")])
        with freed(spark):
            return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    pairs = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not done(pairs):
        # a large step gives no more rows than it gets, so only the small one's are made distinct
        pairs = settled(star(star(pairs, True), False).distinct())
    ids = both_ways(pairs, [F.col("a").alias("id"), F.col("b").alias("component")], [F.col("b").alias("id"), F.col("b").alias("component")])
    return ids.groupBy("id").agg(F.min("component").alias("component"))
