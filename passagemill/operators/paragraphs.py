"""Paragraphs and books.

Two forms of the same data: a row for each paragraph (``book_id, para_idx, text``), and a row
for each book (``book_id, texts, chapters``). A table of whole documents becomes the second
form without any shuffle; paragraph rows need one, on book_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def explode_paragraphs(docs: DataFrame, book: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line of each document. A null text has no paragraph; an empty one has one, empty."""
    return docs.select(F.col(book).cast("long").alias("book_id"), F.posexplode(F.split(text, "\n")).alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))


def index_rows(rows: DataFrame, group: str, *order: str, index: str = "para_idx") -> DataFrame:
    """Numbers the rows of each group from 0 in an explicit order."""
    return rows.withColumn(index, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long") - 1)


def books_of_documents(docs: DataFrame, book: str = "doc_id", text: str = "text", chapters: Column | None = None) -> DataFrame:
    """(book_id, texts, chapters) from whole documents, row by row.

    chapters: an expression over ``texts`` that gives the chapter of each; null where there are none.
    """
    books = docs.where(F.col(text).isNotNull()).select(F.col(book).cast("long").alias("book_id"), F.split(text, "\n").alias("texts"))
    return books.withColumn("chapters", F.lit(None).cast("array<string>") if chapters is None else chapters)


def books_of_paragraphs(rows: DataFrame) -> DataFrame:
    """(book_id, texts, chapters) from paragraph rows: one exchange on book_id; a task holds one book at a time."""
    chapter = F.col("chapter") if "chapter" in rows.columns else F.lit(None).cast("string")
    packed = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("para_idx", F.coalesce("text", F.lit("")).alias("text"), chapter.alias("chapter")))).alias("p"))
    return packed.select("book_id", F.transform("p", lambda x: x["text"]).alias("texts"), F.transform("p", lambda x: x["chapter"]).alias("chapters"))


#: Rows and bytes that are Python objects at once; a row above that is alone.
SLICE_ROWS, SLICE_BYTES = 64, 256 << 10


def slices(batch: pa.Array) -> Iterator[pa.Array]:
    """The batch in runs of rows of a bounded size; together they are all of its rows, in order."""
    at = 0
    while at < len(batch):
        n = SLICE_ROWS
        while n > 1 and batch.slice(at, n).nbytes > SLICE_BYTES:
            n //= 2
        yield batch.slice(at, n)
        at += n


def exact_tokens(rows: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds exact_tokens, counted by a tokenizer file that every executor finds at the path ``vocabulary``; null for a null text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(vocabulary).encode_batch
        for batch in batches:
            for texts in slices(batch):
                known = iter(encode([x for x in texts.to_pylist() if x is not None], add_special_tokens=False))
                yield pa.array([len(next(known).ids) if x else None for x in texts.is_valid().to_pylist()], pa.int64())

    return rows.withColumn("exact_tokens", F.arrow_udf(run, "long")(text))


def tagged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tagged", T.tag(F.col("para_idx"), F.col("text")))


def weighed(rows: DataFrame) -> DataFrame:
    """Adds n (paragraphs of the book), words (of the tagged row) and before (words of all rows above it)."""
    book = Window.partitionBy("book_id")
    above = book.orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("words", T.word_count("text") + 2)
    return rows.withColumn("before", F.coalesce(F.sum("words").over(above), F.lit(0))).withColumn("n", F.count("*").over(book))
