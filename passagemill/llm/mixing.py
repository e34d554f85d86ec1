"""Operator 7, mixing sources to target weights by Sainte-Laguë apportionment.

Each source has a target number of words: its share by weight of 150 % of all words, at
most twice its size, what is above going to the others by weight. The documents of a
(source, shard) cell stand on a tape in seeded hash order; the tape is cut into blocks of
near-equal size. Quotas of whole blocks go to sources, and then to the shards of each
source, by highest quotients votes / (2 n + 1). A cell takes each block quota div blocks
times, and a run of the tape's blocks from a seeded place once more, so no word is taken over
twice and only documents at the ends of a run are cut.

Shards are by hash, the square root of the number of documents in all, so a hot source is
spread over all of them, and neither a cell's tape nor the cells of a source grow faster
than that root. Tables of sources and cells stay in Spark.

Edge cases: null and empty texts have size 0 and nothing is taken; the null source comes
last and is a source of its own; sources without a word have target 0; repeated rows and
equal ids stand on the tape one by one; an empty table gives no row. Reruns agree: order
and choices come from hashes of id, size and seed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: Halvings of the search for a group's last quotient: down to neighbouring floating-point numbers.
STEPS = 110


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(key, source_size, target) of each source, from (key, source, size). One row a source is all that meets in a task."""
    by = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("cap", cap * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    by = by.withColumn("water", (total - full) / rest)
    first = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(Window.partitionBy())
    water = F.coalesce(first["water"], F.lit(float("inf")))
    return by.select("key", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.col("w") * water)).alias("target"))


def seats(table: DataFrame, votes: str, most: str, total, by: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë seats of each row among the rows of equal ``by``, ``most`` at most, ``total`` in all.

    The seats go to the highest quotients votes / (2 n + 1), n < most. A row has
    floor((votes / q + 1) / 2) quotients of q or more, so the last quotient is found by
    halving; of rows that tie there, the first by key and shard get what is left.
    """
    held = lambda v, m, q: F.least(m, F.floor((v / q + 1) / 2)).cast("long")
    groups = table.groupBy(*by).agg(F.max(total).alias("__total"), F.collect_list(F.when(F.col(votes) > 0, F.struct(F.col(votes).alias("v"), F.col(most).alias("m")))).alias("__rows"))

    def seated(q):
        return F.aggregate("__rows", F.lit(0).cast("long"), lambda a, x: a + held(x["v"], x["m"], q))

    def halved(acc, _):
        middle = (acc["lo"] + acc["hi"]) / 2
        return F.when(seated(middle) >= F.col("__total"), F.struct(middle.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))

    highest = F.coalesce(F.array_max(F.transform("__rows", lambda x: x["v"])), F.lit(0.0)) * 2 + 1
    start = F.struct(F.lit(0.0).alias("lo"), highest.alias("hi"))  # none of hi or more; at 0 every seat that may be had
    last = groups.withColumn("__q", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halved))
    last = last.select(*by, "__q", (F.col("__total") - seated(F.col("__q.hi"))).alias("__left"))
    t = table.join(last, by)
    open_ = F.col(votes) > 0
    t = t.withColumn("__base", F.when(open_, held(F.col(votes), F.col(most), F.col("__q.hi"))).otherwise(0).cast("long"))
    every = F.when(F.col("__q.lo") > 0, held(F.col(votes), F.col(most), F.col("__q.lo"))).otherwise(F.col(most))
    t = t.withColumn("__next", open_ & (every > F.col("__base")))
    order = Window.partitionBy(*by, "__next").orderBy("key", *(["shard"] if "shard" in table.columns else []))
    won = F.when(F.col("__next") & (F.row_number().over(order) <= F.col("__left")), 1).otherwise(0)
    return t.withColumn("quota", (F.col("__base") + won).cast("long")).drop("__q", "__left", "__base", "__next")


def spans(docs: DataFrame, seed: int = 17, block: int = 64, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, carry: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and parts: (first word, words, times) of what is taken of each document."""
    common.ensure_checkpoint_dir(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    sized = docs.select("doc_id", "source", key.alias("key"), size.alias("size"), *carry).withColumn("mix", F.xxhash64("doc_id", "size", F.lit(seed)))
    small = sized.select("doc_id", "source", "key", "size", "mix", *carry).checkpoint()
    shards = max(1, math.isqrt(small.count()))
    small = small.withColumn("shard", F.pmod(F.xxhash64("mix", F.lit(seed + 1)), F.lit(shards)))
    goal = targets(small, share, cap, weights)
    cells = small.groupBy("key", "shard").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block))).otherwise(0).cast("long"))
    sources = cells.groupBy("key").agg(F.sum("blocks").alias("all_blocks")).join(goal, "key")
    sources = sources.withColumn("most", 2 * F.col("all_blocks")).withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("all_blocks") / F.col("source_size")).otherwise(0.0))
    total = F.round(F.sum("votes").over(Window.partitionBy(F.lit(1)))).cast("long")
    # the tables of sources and cells are small and read more than once: each is made once, so that plans stay short
    sources = sources.withColumn("n", total).checkpoint()
    quotas = seats(sources, "votes", "most", F.col("n"), ["n"]).select("key", "source_size", "target", "all_blocks", F.col("quota").alias("source_quota"))
    cells = cells.join(quotas, "key").withColumn("most", 2 * F.col("blocks")).checkpoint()
    cells = cells.withColumn("votes", F.when(F.col("all_blocks") > 0, F.col("source_quota") * F.col("blocks") / F.col("all_blocks")).otherwise(0.0))
    cells = seats(cells, "votes", "most", F.col("source_quota"), ["key"]).select("key", "shard", "words", "blocks", "quota", "source_size", "target").checkpoint()
    tape = Window.partitionBy("key", "shard").orderBy("mix", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("s", F.coalesce(F.sum("size").over(tape), F.lit(0))).withColumn("e", F.col("s") + F.col("size")).join(cells, ["key", "shard"])
    once_more = F.when(F.col("blocks") > 0, F.expr("quota % blocks")).otherwise(0)
    placed = placed.withColumn("c", F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.col("blocks") - once_more + 1))
    parts = F.expr("""
        filter(transform(sequence(greatest(0L, s * blocks div words - 1), least(blocks - 1, e * blocks div words + 1)), i -> struct(
            greatest(s, i * words div blocks) - s as start,
            least(e, (i + 1) * words div blocks) - greatest(s, i * words div blocks) as n,
            quota div blocks + if(i >= c and i < c + quota % blocks, 1L, 0L) as times)), x -> x.n > 0 and x.times > 0)
    """)
    none = F.array().cast("array<struct<start:bigint,n:bigint,times:bigint>>")
    placed = placed.withColumn("parts", F.when((F.col("size") > 0) & (F.col("quota") > 0), parts).otherwise(none))
    taken = F.expr("aggregate(parts, 0L, (a, x) -> a + x.n * x.times)")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "parts", *carry)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: up to two rows a document, of the words that are taken once and twice; columns as given.

    A document taken whole keeps its text; of others the taken words stay with the white
    space that follows them, up to the last one. n_chars follows the text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    took = spans(docs.select("doc_id", "source", "text", row), carry=["__row"], **options)
    copies = took.withColumn("__copy", F.explode(F.array(F.lit(1), F.lit(2))))
    copies = copies.withColumn("__own", F.expr("filter(parts, x -> x.times >= __copy)")).where("size(__own) > 0")
    whole = F.expr("aggregate(__own, 0L, (a, x) -> a + x.n)") == F.col("size")
    # words with what follows them, but only of documents that are cut
    words = F.split(F.regexp_replace(F.col("__row.text"), f"^{common.GAP}", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    copies = copies.withColumn("__words", F.when(~whole, words))
    cut = F.expr("array_join(flatten(transform(__own, x -> slice(__words, cast(x.start + 1 as int), cast(x.n as int)))), '')")
    text = F.when(whole, F.col("__row.text")).otherwise(F.regexp_replace(cut, f"{common.GAP}$", ""))
    copies = copies.withColumn("__text", text)
    changed = {"text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return copies.select(*[(changed[c] if c in changed else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
