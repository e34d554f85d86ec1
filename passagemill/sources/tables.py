"""Readers. Each gives explicit positions, because rows have no order of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schemas import HEADINGS, conform


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, required: list[str] | None = None) -> DataFrame:
    """A Parquet table, checked against ``schema``; only the schema's columns are read."""
    df = spark.read.parquet(path)
    return conform(df, schema, required) if schema else df


def of_book(df: DataFrame, book, column: str = "book_name") -> DataFrame:
    """The rows of one book; the filter reaches the scan. Fails if there are none."""
    rows = df.where(F.col(column) == book)
    if rows.isEmpty():
        raise LookupError(f"no rows with {column} = {book!r}")
    return rows


def with_positions(df: DataFrame, index: str = "row_idx") -> DataFrame:
    """Numbers the rows of a file scan from 0 by file, place in the file and order there.

    df: a scan that still has its ``_metadata``. Only a row for each split meets in one task.
    """
    cols = df.columns
    t = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    t = t.withColumn("__r", F.row_number().over(Window.partitionBy("__f", "__b").orderBy("__m")) - 1)
    splits = t.groupBy("__f", "__b").agg(F.count("*").alias("__c"))
    above = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__f", "__b", F.coalesce(F.sum("__c").over(above), F.lit(0)).alias("__o"))
    return t.join(splits, ["__f", "__b"]).select((F.col("__o") + F.col("__r")).cast("long").alias(index), *cols)


def read_embedding_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, embedding) of a matrix written as CSV: a header line, then every column is a dimension."""
    names = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    numbered = with_positions(spark.read.csv(path, header=True, schema=schema, mode="FAILFAST"))
    return numbered.select("row_idx", F.array(*[F.col(f"`{c}`") for c in names]).alias("embedding"))


def read_book_list(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, book_name): one stripped name a line, empty lines left out. A missing file fails."""
    lines = with_positions(spark.read.text(path))
    return lines.select("row_idx", X.strip("value").alias("book_name")).where("book_name <> ''")


def read_excel(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(row_idx, text) of one column of a sheet. The sheet is read on the driver: ingest it once, to Parquet."""
    return _sheet(spark, path, {column: "text"})


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """row_idx and the known columns of a sheet (paragraphs, chunks, propositions or questions), all as text."""
    return _sheet(spark, path, HEADINGS)


def _sheet(spark: SparkSession, path: str, headings: dict[str, str]) -> DataFrame:
    import pandas as pd

    frame = pd.read_excel(path)
    known = [c for c in frame.columns if c in headings]
    if not known:
        raise LookupError(f"{path} has none of the columns {', '.join(headings)}")
    rows = [(i, *(None if pd.isna(v) else str(v) for v in row)) for i, row in enumerate(frame[known].itertuples(index=False))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("row_idx", T.LongType()), *(T.StructField(headings[c], T.StringType()) for c in known)]))


def read_any(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """A table of ``schema`` from Parquet, CSV (with a header line) or a sheet, by the ending of the path."""
    if path.endswith(".xlsx"):
        index = next((c for c in ("para_idx", "chunk_id", "q_idx") if c in schema.names), "row_idx")
        df = read_sheet(spark, path).withColumnRenamed("row_idx", index)
        df = df.withColumnRenamed("chunk", "text") if "chunk" not in schema.names else df
        if "book_id" not in df.columns:  # a sheet holds one book
            df = df.withColumn("book_id", F.lit(0).cast("long"))
        return conform(df.withColumn("book_id", F.col("book_id").cast("long")), schema, required)
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
        numbers = [f.name for f in schema if isinstance(f.dataType, T.LongType) and f.name in df.columns]
        return conform(df.withColumns({c: F.col(c).cast("long") for c in numbers}), schema, required)
    return read_parquet(spark, path, schema, required)
