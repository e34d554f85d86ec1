"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, by_folder: bool = False, mode: str = "overwrite") -> None:
    """Parquet sorted by book, so that a book's row groups can be skipped to; ``by_folder``: a folder a book (for few books)."""
    if by_folder:
        chunks.repartition("book_id").sortWithinPartitions("book_id", "chunk_id").write.mode(mode).partitionBy("book_id").parquet(path)
    else:
        chunks.repartitionByRange("book_id").sortWithinPartitions("book_id", "chunk_id").write.mode(mode).parquet(path)


def write_embedding_csv(rows: DataFrame, path: str, index: str = "row_idx", dims: int | None = None) -> None:
    """A matrix as CSV in row order, with a header line; files in order of their names.

    dims: the vectors' length; looked up in the first row if not given.
    """
    dims = dims or len(rows.first()["embedding"])
    cols = [F.element_at("embedding", k + 1).alias(f"d{k}") for k in range(dims)]
    rows.repartitionByRange(index).sortWithinPartitions(index).select(cols).write.mode("overwrite").option("header", True).csv(path)


def write_lines(names: DataFrame, path: str, column: str = "book_name", index: str = "row_idx") -> None:
    names.repartitionByRange(index).sortWithinPartitions(index).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with quoted line ends, readable with multiLine; white space at the ends of a text stays."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_excel(df: DataFrame, path: str) -> None:
    """A sheet of one book's rows, made on the driver (a book is small); needs an Excel writer of pandas."""
    df.toPandas().to_excel(path, index=False)
