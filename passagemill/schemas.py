"""Schemas of the tables, and the check of a frame against one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "string": T.StringType(), "vector": T.ArrayType(T.DoubleType())}


def _of(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(","))])


PARAGRAPHS = _of("book_id bigint, book_name string, para_idx bigint, chapter string, text string")
CHUNKS = _of("book_id bigint, book_name string, chunk_id bigint, start_idx bigint, end_idx bigint, chapter string, chunk string")
ANNOTATED = _of("book_id bigint, book_name string, chunk_id bigint, chapter string, chunk string, question string, answer string, must_contain string")
CORPORA = _of("book_id bigint, corpus string, chunk_id bigint, text string, embedding vector")
QUERIES = _of("book_id bigint, queries string, q_idx bigint, q_vec vector")
QUESTIONS = _of("book_id bigint, q_idx bigint, question string, answer string, must_contain string, proposition_answer string")
EMBEDDINGS = _of("book_id bigint, method string, row_idx bigint, embedding vector")


#: Column headings of the sheets, and the names that they have here.
HEADINGS = {
    "Book Name": "book_name",
    "Book ID": "book_id",
    "Chapter": "chapter",
    "Chunk": "chunk",
    "Propositions": "text",
    "Question": "question",
    "Answer": "answer",
    "Chunk Must Contain": "must_contain",
}


class SchemaError(ValueError):
    """A table lacks a column, or has it in another type."""


def conform(df: DataFrame, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """``df`` with the schema's columns in their types. A column that isn't ``required`` and is missing becomes null.

    Extra columns are dropped; a string isn't cast to a number.
    """
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in schema:
        if f.name not in have:
            if required is None or f.name in required:
                raise SchemaError(f"column {f.name} is missing")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        if isinstance(have[f.name], T.StringType) != isinstance(f.dataType, T.StringType):
            raise SchemaError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
        out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(out)


def reject_null(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(rows whose column is there, number of rows that lack it)."""
    return df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull()).count()
