"""Operator 9, near-duplicate documents by DartMinHash.

A document is its set of five-word shingles (or its multiset, with ``weights="count"``).
Darts arrive in the region of each weighted element as a hashed Poisson process; each dart
falls on one of ``k`` coordinates, and the earliest dart on a coordinate is its signature
value, so a signature costs about n + k log k steps. Bands of signature values bring
candidates together; every link is verified by the exact similarity of the shingles.

Equal texts are collapsed first. In each bucket all members are compared with its first
member (a star), which joins most of a group at a cost of its size. Of the buckets that then
still hold several classes, the pairs of different classes whose signatures allow the
threshold are verified, each in the first band that it shares, likeliest first, until the
bucket's classes are joined or all its pairs are tried; only links that join classes are
emitted. So no link between different texts is left out but by the chance of the signature.
Large buckets are split by salt, and pairs of parts go to different tasks; parts of the
largest class of a bucket meet only those of the others. The members of a star are dealt to
parts too: the first member's shingles are sent once a part, and members stream past them.
Joins on a bucket or a first member carry a salt, so that no task gets a large one whole.

Edge cases: texts without a word, and null texts, stand alone; equal texts with a word
are copies of each other, also under five words, where only copies link; repeated rows
and equal ids fall into one class, whatever their texts; an empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

K, ROWS = 80, 4
#: Documents, and shingles, of a part of a bucket: what a task holds is bounded by two parts.
PART, PART_SHINGLES = 256, 250_000
#: Pairs that are compared at once.
PAIRS = 1 << 15


def shingles(text: bytes | None, size: int = 5, weights: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their weights."""
    values, counts, cut = shingle_sets([text or b""], size, weights)
    return values[: cut[1]], counts[: cut[1]]


def shingle_sets(texts: list[bytes], size: int = 5, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of several texts, one after the other, and where each begins (and the last ends)."""
    starts, h, _ = windows.hash_words(b"\n".join(texts))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    grams = windows.window_hash(h, size, windows._ODD1)
    own = doc[: len(grams)]
    inside = own == doc[len(doc) - len(grams) :]
    grams, own = grams[inside], own[inside]
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    first = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])][: len(grams)])
    counts = np.diff(np.r_[first, len(grams)]).astype(np.float64)
    return grams[first], counts if weights == "count" else np.ones(len(first)), np.searchsorted(own[first], np.arange(len(texts) + 1))


def darts(values: np.ndarray, weights: np.ndarray, k: int = K, seed: int = 1) -> np.ndarray:
    """The k signature values (64-bit dart names) of a weighted set that is not empty."""
    return dart_sets(values, weights, np.array([0, len(values)]), k, seed)[0]


def dart_sets(values: np.ndarray, weights: np.ndarray, cut: np.ndarray, k: int = K, seed: int = 1) -> np.ndarray:
    """A row of k signature values for each of the sets values[cut[i]:cut[i + 1]] (zeros for an empty one).

    Element i of weight w owns the strip [0, w] x [0, rank). Unit pieces of the strip have
    their own dart sequence: gaps are exponential, a dart's height in the piece is uniform,
    and the darts above w don't count. All of it hangs on the element only, so equal
    regions of two sets hold the same darts. A set throws the darts up to a rank by which
    every coordinate probably has one, and doubles it where one hasn't.
    """
    sets = len(cut) - 1
    if sets == 1 and len(values) > SLICE:
        return _wide_set(values, weights, k, seed)[None]
    pieces = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(values)), pieces)
    piece = np.arange(len(element)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    own = np.repeat(np.arange(sets), np.diff(cut))[element]
    base = windows._mix(values[element] + windows._mix(piece.astype(np.uint64) + np.uint64(seed << 20)))
    room = weights[element] - piece
    total = np.bincount(own, room.clip(max=1), minlength=sets)
    reach = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    rank, thrown = np.zeros(len(base)), np.zeros(len(base), np.uint64)
    best, name = np.full(sets * k, np.inf), np.zeros(sets * k, np.uint64)
    ids, held, names = np.arange(len(base)), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    while True:
        while len(ids):
            thrown[ids] += np.uint64(1)
            h = windows._mix(base[ids] ^ windows._mix(thrown[ids] * np.uint64(0xD6E8FEB86659FD93)))
            rank[ids] -= np.log((windows._mix(h ^ np.uint64(0xA5A5)).astype(np.float64) + 1) / 18446744073709551617.0)
            over = rank[ids] > reach[own[ids]]
            held, names = np.concatenate([held, ids[over]]), np.concatenate([names, h[over]])
            ids, h = ids[~over], h[~over]
            _land(ids, h, own, rank, room, best, name, k)
        short = ~np.isfinite(best.reshape(sets, k)).all(axis=1) & (total > 0)
        if not short.any():
            return name.reshape(sets, k)
        reach[short] *= 2
        again = short[own[held]]
        held, names = held[again], names[again]
        near = rank[held] <= reach[own[held]]
        ids, h = held[near], names[near]
        held, names = held[~near], names[~near]
        _land(ids, h, own, rank, room, best, name, k)


#: Elements of a set that are thrown at once; larger sets go slice by slice.
SLICE = 1 << 17


def _wide_set(values: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The signature of one set that is not empty, of any size, with the work arrays of a slice."""
    reach = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        best, name = np.full(k, np.inf), np.zeros(k, np.uint64)
        for at in range(0, len(values), SLICE):
            v, w = values[at : at + SLICE], weights[at : at + SLICE]
            pieces = np.ceil(w).astype(np.int64)
            element = np.repeat(np.arange(len(v)), pieces)
            piece = np.arange(len(element)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            base = windows._mix(v[element] + windows._mix(piece.astype(np.uint64) + np.uint64(seed << 20)))
            own, rank, room, ids, thrown = np.zeros(len(base), np.int64), np.zeros(len(base)), w[element] - piece, np.arange(len(base)), 0
            while len(ids):
                thrown += 1
                h = windows._mix(base[ids] ^ windows._mix(np.array([thrown], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                rank[ids] -= np.log((windows._mix(h ^ np.uint64(0xA5A5)).astype(np.float64) + 1) / 18446744073709551617.0)
                ids, h = ids[near := rank[ids] <= reach], h[near]
                _land(ids, h, own, rank, room, best, name, k)
        if np.isfinite(best).all():
            return name
        reach *= 2


def _land(ids, h, own, rank, room, best, name, k) -> None:
    """Keeps the earliest dart of each coordinate of each set."""
    ok = (h >> np.uint64(11)).astype(np.float64) / 9007199254740992.0 <= room[ids]
    ids, h = ids[ok], h[ok]
    slot = own[ids] * k + (windows._mix(h + np.uint64(7)) % np.uint64(k)).astype(np.int64)
    r = rank[ids]
    np.minimum.at(best, slot, r)
    won = best[slot] == r
    name[slot[won]] = h[won]


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = b[at] == a
    both = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def _least(threshold: float, k: int) -> int:
    """Equal signature values that a pair at the threshold has but for a vanishing probability."""
    return max(1, math.floor(k * threshold - 4.5 * math.sqrt(k * threshold * (1 - threshold))))


def _set(v: pa.Scalar, w: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and weights of a row; no weights are stored where all are 1."""
    values = np.frombuffer(v.as_buffer(), np.uint64)
    return values, np.frombuffer(w.as_buffer(), np.float32).astype(float) if len(w.as_buffer()) else np.ones(len(values))


def _with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows that stand below their leader: a table of a batch's rows, and the places of members and of their leaders in it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        lead = table["lead"].to_numpy(zero_copy_only=False)
        of = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
        members = np.flatnonzero(~lead)
        yield table, members, of[members]
        held = table.slice(int(of[-1]), 1).combine_chunks().to_batches()[0]


def _stars(stars: DataFrame, known: DataFrame, sets: DataFrame, threshold: float, k: int) -> DataFrame:
    """The links (a, b) among the pairs (tid, leader): first by signature, then by exact similarity."""
    least = _least(threshold, k)

    def dealt(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """Members below their leaders: the columns of ``rows`` for both, at most PART members a part."""
        salted = pairs.withColumn("salt", common.salt("tid"))
        sizes = salted.groupBy("leader").agg(F.count("*").alias("c"), common.salts())
        sizes = sizes.withColumn("parts", F.ceil(F.col("c") / PART).cast("int"))
        members = salted.join(common.by_salt(sizes.select("leader", "parts", "salts")), ["leader", "salt"])
        members = members.select("leader", F.pmod(F.xxhash64("tid"), "parts").cast("int").alias("part"), F.lit(False).alias("lead"), "tid")
        heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"), F.col("leader").alias("tid"))
        both = members.join(rows, "tid").unionByName(heads.join(rows, "tid"))
        return both.repartition("leader", "part").sortWithinPartitions("leader", "part", F.desc("lead"), "tid")

    def likely(batches):
        for t, a, b in _with_leaders(batches):
            if len(a):
                sig, n = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(t), k), t["n"].to_numpy()
                ok = (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9) & ((sig[a] == sig[b]).sum(axis=1) >= least)
                tid = t["tid"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(tid[a[ok]]), pa.array(tid[b[ok]])], names=["tid", "leader"])

    def exact(batches):
        for t, a, b in _with_leaders(batches):
            v, w, rep = t["v"], t["w"], t["rep"].to_numpy()
            ok, last, head = np.zeros(len(a), dtype=bool), -1, None
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if y != last:
                    last, head = y, _set(v[y], w[y])
                ok[i] = similarity(*_set(v[x], w[x]), *head) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(rep[a[ok]]), pa.array(rep[b[ok]])], names=["a", "b"])

    pairs = common.settled(dealt(stars, known.select("tid", "n", "sig")).mapInArrow(likely, "tid long, leader long"))
    return dealt(pairs, sets).mapInArrow(exact, "a long, b long")


def _first_shared(x: np.ndarray, y: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The first band in which signature rows agree (value r of band t stands at r * bands + t)."""
    return (x == y)[:, : bands * rows].reshape(len(x), rows, bands).all(axis=1).argmax(axis=1)


def _pairs_within(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (p, q), p of ``left`` and q > p or of ``right`` only, that share a group (ascending), in runs of about PAIRS."""
    ends = np.searchsorted(group, group, side="right")
    begins = np.searchsorted(group, group, side="left")
    p = np.flatnonzero(left)
    counts = ends[p] - begins[p]
    sums = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(p):
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, side="right")) - 1)
        part, n = p[at:stop], counts[at:stop]
        a = np.repeat(part, n)
        b = np.repeat(begins[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ok = right[b] & (~left[b] | ~right[a] | (b > a))
        yield a[ok], b[ok]
        at = stop


_KEY = ["band", "h", "i", "j"]
_MEMBER = "band int, h long, i long, j long, salt long, tid long, rep long, class long, n long, sig binary"


def _across(members: DataFrame, known: DataFrame, found: DataFrame, sets: DataFrame, threshold: float, k: int, rows: int) -> DataFrame:
    """Links (a, b) between different classes that share a bucket: enough of them to join all that are linked."""
    m = members.join(known.select("tid", "rep", "n"), "tid")
    m = m.join(found.select(F.col("id").alias("rep"), F.col("component").alias("class")), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    m = m.select("band", "h", "salt", "tid", "rep", "class", "n")
    per = m.groupBy("band", "h", "class").agg(F.count("*").alias("c"), F.sum("n").alias("s"), common.salts())
    most = F.struct("c", "class")
    mixed = per.groupBy("band", "h").agg(
        F.count("*").alias("classes"), F.max(most).alias("main"), F.max_by("s", most).alias("main_s"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.bit_or("salts").alias("salts")
    ).where("classes > 1")
    parts = lambda c, s: F.greatest(F.lit(1), F.ceil(F.greatest(c / PART, s / PART_SHINGLES))).cast("long")
    # a large bucket: its largest class has parts of its own, which meet those of the others, never each other
    mixed = mixed.withColumn("large", parts(F.col("c"), F.col("s")) > 1).select(
        "band", "h", "large", "salts", F.col("main.class").alias("main"),
        parts(F.col("c") - F.col("main.c"), F.col("s") - F.col("main_s")).alias("others"), parts(F.col("main.c"), F.col("main_s")).alias("mains"),
    )
    m = m.join(common.by_salt(mixed), ["band", "h", "salt"]).join(known.select("tid", "sig"), "tid").withColumn("in_main", F.col("large") & (F.col("class") == F.col("main")))
    spread = F.xxhash64("tid")
    m = m.withColumn("salt", F.when(~F.col("large"), 0).when(F.col("in_main"), F.col("others") + F.pmod(spread, "mains")).otherwise(F.pmod(spread, "others")).cast("long"))
    last = F.when(~F.col("large"), 0).when(F.col("in_main"), F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1).cast("long")
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    m = m.withColumn("i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other")).select(*_KEY, "salt", "tid", "rep", "class", "n", "sig")
    least, bands = _least(threshold, k), k // rows

    def pairs_of(table: pa.Table):
        """The group of each row, and (p, q, equal values) of the pairs to verify, from the rows of whole groups."""
        cols = [table[c].to_numpy() for c in _KEY]
        group = np.cumsum(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        salt, own, n = (table[c].to_numpy() for c in ("salt", "class", "n"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(n), k)
        out = [(np.zeros(0, np.int64),) * 3]
        for p, q in _pairs_within(group, salt == cols[2], salt == cols[3]):
            ok = (own[p] != own[q]) & (np.minimum(n[p], n[q]) >= threshold * np.maximum(n[p], n[q]) - 1e-9)
            p, q = p[ok], q[ok]
            equal = (sig[p] == sig[q]).sum(axis=1)
            ok = equal >= least
            p, q, equal = p[ok], q[ok], equal[ok]
            ok = _first_shared(sig[p], sig[q], bands, rows) == cols[0][p]
            out.append((p[ok], q[ok], equal[ok]))
        return group, *(np.concatenate(x) for x in zip(*out))

    def partners(batches):
        for table in common.whole_groups(batches, _KEY):
            _, p, q, _ = pairs_of(table)
            if len(p):
                yield from table.take(pa.array(np.unique(np.concatenate([p, q])))).to_batches()

    def verify(batches):
        for table in common.whole_groups(batches, _KEY):
            group, p, q, equal = pairs_of(table)
            ids, own, v, w = table["rep"].to_numpy(), table["class"].to_numpy(), table["v"], table["w"]
            parent: dict[tuple[int, int], tuple[int, int]] = {}

            def root(x: tuple[int, int]) -> tuple[int, int]:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            edges = []
            for t in np.argsort(-equal, kind="stable"):
                a, b = int(p[t]), int(q[t])
                x, y = root((int(group[a]), int(own[a]))), root((int(group[b]), int(own[b])))
                if x == y:
                    continue
                if similarity(*_set(v[a], w[a]), *_set(v[b], w[b])) >= threshold:
                    parent[max(x, y)] = min(x, y)
                    edges.append((int(max(ids[a], ids[b])), int(min(ids[a], ids[b]))))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[s] for e in edges], pa.int64()) for s in (0, 1)], names=["a", "b"])

    likely = m.repartition(*_KEY).sortWithinPartitions(*_KEY, "tid").mapInArrow(partners, _MEMBER)
    full = likely.join(sets.select("tid", "v", "w"), "tid").select(*_KEY, "salt", "tid", "rep", "class", "n", "sig", "v", "w")
    return full.repartition(*_KEY).sortWithinPartitions(*_KEY, "tid").mapInArrow(verify, "a long, b long")


def _of_one_id(own: DataFrame) -> DataFrame:
    """Links between the classes of equal texts that one doc_id has; own: (doc_id, rep) of every row."""
    several = own.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most")
    return own.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, k: int = K, rows: int = ROWS, weights: str = "set", seed: int = 1) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id of its class), kept (it is that document)."""
    spark = docs.sparkSession
    common.ensure_checkpoint_dir(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fine = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False)) & F.col("doc_id").isNotNull()
    keyed = base.select("doc_id", fine.alias("fine"), F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(seed)).alias("k2"), "text")
    bands = k // rows

    def sign(batches):
        for frame in batches:
            # equal texts of a batch are one row and signed once
            once = frame.groupby(["k1", "k2"], sort=False).agg(doc_id=("doc_id", "min"), text=("text", "first")).reset_index()
            texts = once.pop("text").tolist()
            for a, b in common.chunks(texts):
                v, w, cut = shingle_sets(texts[a:b], size, weights)
                name = dart_sets(v, w, cut, k, seed)
                key = np.zeros((b - a, bands), np.uint64)
                for r in range(rows):
                    key = windows._mix(key * np.uint64(31) + name[:, r * bands : (r + 1) * bands])
                some = np.diff(cut) > 0
                n = np.add.reduceat(np.append(w, 0.0), cut[:-1])[: b - a].astype(np.int64) * some
                keys = [x.astype(np.int64) if ok else [] for x, ok in zip(key, some, strict=True)]
                sigs = [x.astype(np.uint16).tobytes() if ok else b"" for x, ok in zip(name >> np.uint64(48), some, strict=True)]
                yield once.iloc[a:b].assign(n=n, bands=keys, sig=sigs)

    copies = keyed.where("fine").select("doc_id", "k1", "k2", F.col("text").cast("binary").alias("text"))
    signed = copies.mapInPandas(sign, "k1 long, k2 long, doc_id long, n long, bands array<long>, sig binary")
    reps = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # a distinct text has a number of its own, as one doc_id may have several; it is fixed by the checkpoint
    reps = common.settled(reps.withColumn("tid", F.monotonically_increasing_id()))
    known = reps.select("tid", "rep", "n", "sig")
    banded = reps.select("tid", F.posexplode("bands").alias("band", "h")).withColumn("salt", common.salt("tid"))
    shared = banded.groupBy("band", "h").agg(F.count("*").alias("c"), F.min("tid").alias("leader"), common.salts()).where("c > 1").drop("c")
    members = common.settled(banded.join(common.by_salt(shared), ["band", "h", "salt"]))
    needed = members.select("tid").distinct().join(reps.select("tid", "k1", "k2", "rep"), "tid")

    def hashed(batches):
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch["text"]]
            for a, b in common.chunks(texts):
                v, w, cut = shingle_sets(texts[a:b], size, weights)
                sets = pa.array([v[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())
                scales = pa.array([w[x:y].astype(np.float32).tobytes() if weights == "count" else b"" for x, y in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in ("tid", "rep")), sets, scales], names=["tid", "rep", "v", "w"])

    texts = keyed.where("fine").select(F.col("doc_id").alias("rep"), "k1", "k2", F.col("text").cast("binary").alias("text")).join(needed, ["rep", "k1", "k2"])
    sets = common.settled(texts.select("tid", "rep", "text").mapInArrow(hashed, "tid long, rep long, v binary, w binary").dropDuplicates(["tid"]))
    own = common.settled(keyed.where("fine").select("doc_id", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep"))
    stars = common.settled(members.where("tid <> leader").select("tid", "leader").distinct())
    links = common.settled(_stars(stars, known, sets, threshold, k).union(_of_one_id(own)))
    found = common.settled(common.connected_components(links))
    more = common.settled(_across(members.drop("leader"), known, found, sets, threshold, k, rows))
    if not more.isEmpty():
        found = common.settled(common.connected_components(more.union(found)))  # found: (id, smallest id) of what is joined so far
    good = own.join(found, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    alone = keyed.where("not fine").select("doc_id", F.col("doc_id").alias("class_id"))
    return good.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each class; columns as given. Rows without an id stay.

    Rows of one id are one class, whatever their texts: the one whose text has the smallest
    SHA-256 stays (a null text last), of equal texts the one of the smallest hash of its row.
    """
    kept = classes(docs, **options).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    stay = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    cells = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col("text").isNull(), F.sha2("text", 256), F.xxhash64(*cells))
    one = stay.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("__row")).select("__row.*")
    return one.union(docs.where("doc_id is null"))
