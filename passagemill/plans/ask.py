"""From chunks to chunks with questions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import models
from ..operators import questions


def asked(chunks: DataFrame, model: models.QuestionModel, calls: int = 8, partitions: int | None = None) -> DataFrame:
    """The sampled chunks with reply (null: the model never answered)."""
    rows = questions.sampled(chunks)
    return questions.ask(rows.repartition(partitions) if partitions else rows, model, calls)


def generate(chunks: DataFrame, model: models.QuestionModel, calls: int = 8, partitions: int | None = None) -> DataFrame:
    """Every chunk (book_id, book_name, chunk_id, chunk ...) with question, answer and must_contain where a sampled one parsed."""
    return questions.scattered(chunks, questions.parsed(asked(chunks, model, calls, partitions)))


def generated(chunks: DataFrame, model: models.QuestionModel, path: str, calls: int = 8, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotated chunks, replies): the replies are written to ``path`` and read again, so that no question is sent twice."""
    asked(chunks, model, calls, partitions).select("book_id", "chunk_id", "reply").write.mode("overwrite").parquet(path)
    replies = chunks.sparkSession.read.parquet(path)
    return questions.scattered(chunks, questions.parsed(replies)), replies
