"""From paragraphs or documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import models
from ..operators import boundaries, chunks, paragraphs


def segment(books: DataFrame, model: models.BoundaryModel | None = None, replies: DataFrame | None = None, mode: str = "strict", all_chapters: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(chunks, log of the prompts). Without a model the built-in one is used, inside expressions and without a log.

    The log and the chunks come from the same walk: persist or write ``asked_books`` first if
    both are wanted of a model that costs money.
    """
    if model is None:
        return chunks.assembled(boundaries.fold(books), all_chapters), None
    asked = boundaries.ask(books, model, replies, mode)
    return chunks.assembled(asked, all_chapters), boundaries.reply_log(asked)


def asked_books(books: DataFrame, model: models.BoundaryModel, path: str, replies: DataFrame | None = None, mode: str = "strict") -> DataFrame:
    """The walked books, written to ``path`` and read again, so that no prompt is sent twice."""
    boundaries.ask(books, model, replies, mode).write.mode("overwrite").parquet(path)
    return books.sparkSession.read.parquet(path)


def segment_documents(docs: DataFrame, model: models.BoundaryModel | None = None, book: str = "doc_id", text: str = "text") -> DataFrame:
    return segment(paragraphs.books_of_documents(docs, book, text), model)[0]


def segment_paragraphs(rows: DataFrame, model: models.BoundaryModel | None = None) -> DataFrame:
    return segment(paragraphs.books_of_paragraphs(rows), model)[0]
