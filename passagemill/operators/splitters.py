"""Other granularities of a corpus. The reference only names them, so the rules here are this engine's own.

``by_separators`` splits by a hierarchy of separators; ``by_distance`` cuts where neighbouring
vectors differ most; propositions and hypothetical answers come from plug-in models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, most: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``most`` characters that join to ``text``: whole parts of the first separator that helps are merged, longer parts split by the next."""
    if len(text) <= most:
        return [text] if text else []
    mark, rest = separators[0], separators[1:]
    if not mark:
        return [text[i : i + most] for i in range(0, len(text), most)]
    parts = text.split(mark)
    parts = [p + mark for p in parts[:-1]] + parts[-1:]
    out, held = [], ""
    for part in parts:
        if len(held) + len(part) <= most:
            held += part
            continue
        if held:
            out.append(held)
        held = ""
        if len(part) <= most:
            held = part
        else:
            *whole, held = split_text(part, most, rest or ("",))
            out += whole
    return out + [held] if held else out


def by_separators(docs: DataFrame, most: int = 1000, book: str = "doc_id", text: str = "text") -> DataFrame:
    """(book_id, chunk_id, chunk)."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", most))

    return docs.select(F.col(book).cast("long").alias("book_id"), F.posexplode(split(text)).alias("chunk_id", "chunk")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


def by_distance(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """(book_id, chunk_id, start_idx, end_idx, chunk) from paragraph rows with ``embedding``.

    A chunk starts where the cosine distance to the paragraph above exceeds the book's
    quantile ``share``; both are rounded to nine digits. A zero vector has no distance.
    """
    book = Window.partitionBy("book_id")
    order = book.orderBy("para_idx")
    t = rows.withColumn("__size", F.sqrt(V.dot("embedding", "embedding")))
    above, size = F.lag("embedding").over(order), F.lag("__size").over(order)
    known = (F.col("__size") > 0) & (size > 0)
    t = t.withColumn("gap", F.when(known, F.round(1 - V.dot("embedding", above) / (F.col("__size") * size), 9)))
    t = t.withColumn("limit", F.round(F.percentile("gap", F.lit(share)).over(book), 9))
    t = t.withColumn("chunk_id", F.coalesce(F.sum((F.col("gap") > F.col("limit")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    pieces = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return t.groupBy("book_id", "chunk_id").agg(F.min("para_idx").alias("start_idx"), (F.max("para_idx") + 1).alias("end_idx"), F.array_join(F.transform(pieces, lambda x: x["text"]), "\n").alias("chunk"))


def rewritten(rows: DataFrame, write: Callable[[str], list[str]], text: str = "chunk", out: str = "proposition") -> DataFrame:
    """A row for each text that ``write`` makes of a row: propositions of a chunk, or a hypothetical answer to a question."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield texts.map(lambda t: list(write(t)) if t is not None else [])

    return rows.select("*", F.posexplode(F.pandas_udf(run, "array<string>")(text)).alias("row_idx", out)).withColumn("row_idx", F.col("row_idx").cast("long"))
