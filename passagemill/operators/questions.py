"""Questions: an even sample of a book's chunks, a model's reply to each, and its parts put back."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import text as T

def message(chunk: str, title: str, author: str) -> str:
    """What a question model is sent, as one text."""
    return "\n".join(models.question_messages(chunk, title, author))


def sampled(rows: DataFrame, group: str = "book_id", index: str = "chunk_id") -> DataFrame:
    """Rows 0, step, 2 step ... of each group; adds n and step. Only group and index need the exchange's sort."""
    t = rows.withColumn("n", F.count("*").over(Window.partitionBy(group))).withColumn("step", T.sample_step(F.col("n")))
    return t.where(F.col(index) % F.col("step") == 0)


def ask(chunks: DataFrame, model: models.QuestionModel, calls: int = 8) -> DataFrame:
    """Adds reply. Calls are independent: ``calls`` at a time in each task; repartition to have more tasks."""

    def run(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if hasattr(model, "open"):
            model.open()
        with ThreadPoolExecutor(calls) as pool:
            for texts, titles, authors in frames:
                yield pd.Series(list(pool.map(model.ask, texts, titles, authors)), dtype=object)

    return chunks.withColumn("reply", F.pandas_udf(run, "string")("chunk", T.book_title("book_name"), T.book_author("book_name")))


def parsed(replies: DataFrame) -> DataFrame:
    """Replaces reply by question, answer and must_contain; rows without all three are dropped."""
    names = ("question", "answer", "must_contain")
    t = replies.withColumns({c: T.question_part("reply", k + 1) for k, c in enumerate(names)}).drop("reply")
    return t.where(" and ".join(f"{c} is not null" for c in names))


def scattered(chunks: DataFrame, questions: DataFrame, keys: tuple[str, ...] = ("book_id", "chunk_id")) -> DataFrame:
    """Every chunk, with its question, answer and cleaned passage, or nulls."""
    q = questions.select(*keys, "question", "answer", T.clean_quote(F.col("must_contain")).alias("must_contain"))
    return chunks.join(q, list(keys), "left")
