"""From chunk corpora and questions to retrieval scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from ..schemas import reject_null


def first_ranks(corpora: DataFrame, queries: DataFrame, golds: DataFrame, names: list[str] | None = None, k: int = 20) -> DataFrame:
    """(book_id, method, q_idx, first_rank).

    corpora: book_id, corpus, chunk_id, text, embedding; queries: book_id, queries, q_idx,
    q_vec; golds: book_id, q_idx, must_contain, proposition_answer. The table of methods says
    which of them go together. Questions without their gold are left out (``rejected`` counts them).
    """
    methods = retrieval.method_table(corpora.sparkSession, names)
    own = corpora.join(F.broadcast(methods.select("method", "corpus")), "corpus")  # a row a method
    asked = queries.join(F.broadcast(methods.select("method", "queries")), "queries").select("book_id", "method", "q_idx", "q_vec")
    gold = golds.crossJoin(F.broadcast(methods.select("method", F.col("gold").alias("which"))))
    gold = gold.select("book_id", "method", "q_idx", F.when(F.col("which") == "must_contain", F.col("must_contain")).otherwise(F.col("proposition_answer")).alias("gold"))
    by = ("book_id", "method")
    ranked = retrieval.top_k(asked, own.select(*by, "chunk_id", "embedding"), k, by)
    return retrieval.first_relevant(ranked, own.select(*by, "chunk_id", "text"), gold.where("gold is not null"), by)


def rejected(golds: DataFrame, column: str = "must_contain") -> int:
    """Questions that have no gold."""
    return reject_null(golds, column)[1]


def evaluate(corpora: DataFrame, queries: DataFrame, golds: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(means by book, method and k; the wide report of macro means of DCG by k)."""
    scored = retrieval.at_cuts(first_ranks(corpora, queries, golds, names))
    means = retrieval.on_grid(retrieval.book_means(scored), corpora, retrieval.method_table(corpora.sparkSession, names))
    return means, retrieval.wide(means, names).orderBy("k")
