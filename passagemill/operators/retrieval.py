"""Retrieval and its scores.

Corpus rows and questions of a book (and method) are dealt to blocks of bounded size, whatever
the size of the book and the files that they are read from. Each block of one meets each block
of the other in numpy, which gives back the best of them only, or every pair in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.text import let

CUTS = (1, 2, 5, 10, 20)


@dataclass(frozen=True)
class Method:
    """Where a method has its texts and vectors, its query vectors, and the gold column of a question."""

    name: str
    corpus: str
    queries: str = "questions"
    gold: str = "must_contain"


#: The six methods of the comparison.
METHODS = (
    Method("Custom", "custom"),
    Method("Semantic", "semantic"),
    Method("Paragraph", "paragraph"),
    Method("Langchain", "recursive"),
    Method("Propositions", "propositions", gold="proposition_answer"),
    Method("HyDE", "recursive", queries="hyde"),
)


def method(name: str) -> Method:
    for m in METHODS:
        if m.name == name:
            return m
    raise ValueError(f"unknown method {name!r}; known are {', '.join(m.name for m in METHODS)}")


def method_table(spark, names: list[str] | None = None) -> DataFrame:
    """(method, corpus, queries, gold): one row a method, to be joined."""
    rows = [method(n) for n in names] if names else METHODS
    return spark.createDataFrame([(m.name, m.corpus, m.queries, m.gold) for m in rows], "method string, corpus string, queries string, gold string")


#: Corpus rows and questions of a block, where the best are kept and where every pair is.
BEST_BLOCK, PAIR_BLOCK = (8192, 4096), (2048, 1024)
#: Questions that are scored at once.
TILE = 64


def meet(questions: DataFrame, corpus: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], by: tuple[str, ...], question: str, chunk: str, size: tuple[int, int], blocks: int = 1) -> DataFrame:
    """(by, question, chunk, score) of ``run`` over a block of the corpus and one of the questions, for all such pairs of a group."""
    counts = [t.groupBy(*by).agg(F.count("*").alias(n)) for t, n in ((corpus, "__rows"), (questions, "__asked"))]
    sizes = counts[0].join(counts[1], list(by)) if by else counts[0].crossJoin(counts[1])  # a row a group
    most = lambda n, k, least: F.greatest(F.lit(least).cast("long"), F.ceil(F.col(n) / k))
    sizes = sizes.select(*by, most("__rows", size[0], 1).alias("__parts"), most("__asked", size[1], blocks).alias("__blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sized = lambda t: t.join(sizes, list(by)) if by else t.crossJoin(sizes)
    dealt = lambda *c, n: F.pmod(F.xxhash64(*c), F.col(n))
    key = (*by, "__part", "__block")
    own = [F.col(c).alias(c) for c in by]  # columns of each side's own, where both come of one table
    rows = sized(corpus).select(*own, F.col(chunk).alias(chunk), "embedding", dealt(chunk, "embedding", n="__parts").alias("__part"), every("__blocks").alias("__block"))
    asked = sized(questions).select(*own, F.col(question).alias(question), "q_vec", dealt(question, "q_vec", n="__blocks").alias("__block"), every("__parts").alias("__part"))
    schema = T.StructType([*(T.StructField(c, corpus.schema[c].dataType) for c in by), T.StructField(question, questions.schema[question].dataType), T.StructField(chunk, corpus.schema[chunk].dataType), T.StructField("score", T.DoubleType())])
    return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, schema)


def _tiles(rows: pa.ChunkedArray, asked: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first question, scores, whether null) of every TILE questions against all rows."""
    known, other = V.matrices(rows), V.matrices(asked)
    for at in range(0, len(asked), TILE):
        scores = np.zeros((min(TILE, len(asked) - at), len(rows)))
        null = np.ones(scores.shape, dtype=bool)
        for length, (qs, q) in other.items():
            i, j = np.searchsorted(qs, [at, at + TILE])
            if length in known and i < j:
                cells = np.ix_(qs[i:j] - at, known[length][0])
                scores[cells], null[cells] = V.dots(q[i:j], known[length][1]), False
        yield at, scores, null


def _found(corpus: pa.Table, asked: pa.Table, by: tuple[str, ...], question: str, chunk: str, q: np.ndarray, c: np.ndarray, score: pa.Array) -> pa.Table:
    same = {n: pa.repeat(corpus[n][0], len(q)) for n in by}
    return pa.table({**same, question: asked[question].take(pa.array(q)), chunk: corpus[chunk].take(pa.array(c)), "score": score})


def _best(k: int, by: tuple[str, ...], question: str, chunk: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(corpus: pa.Table, asked: pa.Table) -> pa.Table:
        corpus = corpus.take(pc.sort_indices(corpus, sort_keys=[(chunk, "descending")]))  # so the first of equals is the one that is meant
        q, c, x = ([np.empty(0, t)] for t in (np.int64, np.int64, float))
        missing = [np.empty(0, bool)]
        n = corpus.num_rows
        for at, scores, null in _tiles(corpus["embedding"], asked["q_vec"]) if n else ():
            odd = null.any(axis=1) | np.isnan(scores).any(axis=1)
            least = np.partition(scores, max(0, n - k), axis=1)[:, max(0, n - k)]
            for i, s in enumerate(scores):
                if odd[i]:  # as Spark has it: NaN is above all numbers, null below
                    own = np.lexsort((-s, np.where(null[i], 2, np.where(np.isnan(s), 0, 1))))[:k]
                else:
                    own = np.flatnonzero(s >= least[i])
                    own = own[np.argsort(-s[own], kind="stable")][:k]
                q.append(np.full(len(own), at + i))
                c.append(own)
                x.append(s[own])
                missing.append(null[i, own])
        return _found(corpus, asked, by, question, chunk, np.concatenate(q), np.concatenate(c), pa.array(np.concatenate(x), mask=np.concatenate(missing)))

    return run


def _all(digits: int, question: str, chunk: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(corpus: pa.Table, asked: pa.Table) -> pa.Table:
        n = corpus.num_rows
        none = np.empty(0, np.int64)
        out = [_found(corpus, asked, (), question, chunk, none, none, pa.array([], pa.float64()))]
        for at, scores, null in _tiles(corpus["embedding"], asked["q_vec"]) if n else ():
            of = np.arange(at, at + len(scores))
            out.append(_found(corpus, asked, (), question, chunk, np.repeat(of, n), np.tile(np.arange(n), len(of)), pa.array(V.rounded(scores, digits).ravel(), mask=null.ravel())))
        return pa.concat_tables(out)

    return run


def all_scores(questions: DataFrame, corpus: DataFrame, digits: int = 9, question: str = "q_idx", chunk: str = "chunk_id") -> DataFrame:
    """(question, chunk, score) of every pair, rounded: rows as many as both tables multiplied."""
    return meet(questions, corpus, _all(digits, question, chunk), (), question, chunk, PAIR_BLOCK)


def top_k(questions: DataFrame, corpus: DataFrame, k: int = 20, by: tuple[str, ...] = (), question: str = "q_idx", chunk: str = "chunk_id", score: Column | None = None, blocks: int = 1) -> DataFrame:
    """(by, question, chunk, score, rank) of the k best chunks of each question, ties to the higher chunk.

    questions: by, question, q_vec; corpus: by, chunk, embedding. Without ``by`` every
    question meets every chunk. score: an expression over q.q_vec and embedding, evaluated row
    by row, in place of the inner product. blocks: the fewest that the questions of a group are dealt to.
    """
    if score is None:
        t = meet(questions, corpus, _best(k, by, question, chunk), by, question, chunk, BEST_BLOCK, blocks)
    else:
        block = F.pmod(F.xxhash64(question), F.lit(blocks)).alias("__block")
        gathered = questions.groupBy(*by, block).agg(F.collect_list(F.struct(F.col(question), F.col("q_vec"))).alias("__qs"))
        met = corpus.join(gathered, list(by)) if by else corpus.crossJoin(gathered)  # a row for each block of questions
        t = met.withColumn("q", F.explode("__qs")).drop("__qs").select(*by, F.col(f"q.{question}").alias(question), chunk, score.alias("score"))
    best = Window.partitionBy(*by, question).orderBy(F.col("score").desc(), F.col(chunk).desc())
    return t.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


#: Words of an anchor.
ANCHOR = 3


def _runs(words: Column, run) -> Column:
    """``run(words of the run)`` of every run of ANCHOR words; null where there are fewer. The text is split once, not in each turn of the loop."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - ANCHOR), lambda i: run(*[F.get(w, i + k) for k in range(ANCHOR)]))
        return F.when(F.size(w) >= ANCHOR, runs)

    return let(words, of)


def containing(texts: DataFrame, golds: DataFrame, text: str = "text", chunk: str = "chunk_id", gold: str = "item_id", blocks: int = 1) -> DataFrame:
    """(gold, chunk) of every text that holds a gold passage, ignoring case. golds: gold, passage (a stated set).

    The words of a passage but its first and last stand whole in any text that holds it, so
    its longest run of ANCHOR of them is looked up among the runs of the texts, and only
    texts that have it are searched. Passages too short for that meet every text, in blocks.
    """
    words = lambda c: F.split(c, r"\s+")
    known = golds.where("passage is not null").select(gold, F.lower("passage").alias("__p"))
    inner = let(words("__p"), lambda w: F.slice(w, F.lit(2), F.greatest(F.lit(0), F.size(w) - 2)))
    longest = F.array_max(_runs(inner, lambda *w: F.struct(F.length(F.concat(*w)).alias("chars"), F.xxhash64(*w).alias("run"))))
    known = known.withColumn("__run", longest["run"])
    lowered = texts.where(F.col(text).isNotNull()).select(chunk, F.lower(text).alias("__text"))
    anchors = known.where("__run is not null")
    runs = lowered.select(chunk, F.explode(F.array_distinct(_runs(words("__text"), F.xxhash64))).alias("__run"))
    met = runs.join(anchors.select(gold, "__run"), "__run").select(chunk, gold).distinct()
    found = met.join(lowered, chunk).join(anchors.select(gold, "__p"), gold).where(F.contains("__text", "__p")).select(chunk, gold)
    gathered = known.where("__run is null").groupBy(F.pmod(F.xxhash64(gold), F.lit(blocks))).agg(F.collect_list(F.struct(F.col(gold), F.col("__p").alias("p"))).alias("__gs"))
    held = F.filter("__gs", lambda g: F.contains(F.col("__text"), g["p"]))
    short = lowered.crossJoin(gathered.select("__gs")).select(chunk, F.explode(F.transform(held, lambda g: g[gold])).alias(gold))  # a row for each block of short passages
    return found.union(short)


def first_relevant(ranked: DataFrame, texts: DataFrame, gold: DataFrame, by: tuple[str, ...] = (), question: str = "q_idx", chunk: str = "chunk_id") -> DataFrame:
    """(by, question, first_rank) for every question of ``gold``; null if no ranked text holds its gold.

    texts: by, chunk, text; gold: by, question, gold (neither null). Case is ignored; an empty
    gold is in any text. Texts are looked up for ranked rows only.
    """
    t = ranked.join(texts.select(*by, chunk, F.lower("text").alias("__text")), [*by, chunk])
    lowered = gold.select(*by, question, F.lower("gold").alias("__gold"))
    hits = lowered.join(t, [*by, question], "left")
    return hits.groupBy(*by, question).agg(F.min(F.when(F.contains("__text", "__gold"), F.col("rank"))).alias("first_rank"))


def at_cuts(first: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row for each question and k, with dcg and recall; the search itself isn't repeated."""
    t = first.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in cuts])))
    return t.withColumn("dcg", V.dcg(F.col("first_rank"), F.col("k"))).withColumn("recall", V.recall(F.col("first_rank"), F.col("k")))


def book_means(scored: DataFrame, by: tuple[str, ...] = ("book_id", "method")) -> DataFrame:
    """Mean over the questions of each book and method, for each k. NaN stays NaN."""
    return scored.groupBy(*by, "k").agg(F.avg("dcg").alias("dcg"), F.avg("recall").alias("recall"))


def on_grid(means: DataFrame, books: DataFrame, methods: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """A row for each book, method and k; NaN where there is no question. ``methods`` is a small table."""
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in cuts])).alias("k")
    names = F.array(*[F.lit(r["method"]) for r in methods.select("method").collect()])  # a row a method
    grid = books.select("book_id").distinct().withColumn("method", F.explode(names)).select("book_id", "method", ks)
    nan = F.lit(float("nan"))
    return grid.join(means, ["book_id", "method", "k"], "left").withColumn("dcg", F.coalesce("dcg", nan)).withColumn("recall", F.coalesce("recall", nan))


def macro_means(means: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Unweighted mean over books for each k, leaving NaN out."""
    real = lambda c: F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c)
    return means.groupBy(*by, "k").agg(real("dcg"), real("recall"))


def wide(means: DataFrame, names: list[str] | None = None, value: str = "dcg") -> DataFrame:
    """A row for each k, a column for each method."""
    names = names or [m.name for m in METHODS]
    for n in names:
        method(n)
    return means.groupBy("k").pivot("method", names).agg(F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))))
