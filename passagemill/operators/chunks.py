"""Chunks: the rows between boundaries, with a chapter label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def chapter_label(first: Column, last: Column) -> Column:
    """The chapter if both ends have the same, else both."""
    return F.when(first.eqNullSafe(last), first).otherwise(F.concat_ws(" and ", first, last))


def assembled(books: DataFrame, all_chapters: bool = False, carry: list[str] = ()) -> DataFrame:
    """A row for each chunk of each book row: book_id, chunk_id, start_idx, end_idx, chapter, chunk.

    The last chunk ends with the book. A boundary below the one before gives an empty chunk
    and repeats rows later; one beyond the book is cut to its end. all_chapters: the label
    names every chapter in between too. Nothing is shuffled.
    """
    n = F.size("texts").cast("long")
    ends = F.concat(F.transform("boundaries", lambda b: F.least(b, n)), F.array(n))

    def chunk_of(start: Column, end: Column) -> Column:
        at, rows = (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int")
        part = F.slice("chapters", at, rows)
        if all_chapters:
            label = F.when(rows > 0, F.array_join(F.array_distinct(part), " and "))
        else:
            label = T.let(part, lambda p: F.when(F.size(p) > 0, chapter_label(F.element_at(p, 1), F.element_at(p, -1))))
        text = F.array_join(F.transform(F.slice("texts", at, rows), lambda x: T.strip_left(x)), "\n")
        return F.struct(start.alias("start_idx"), end.alias("end_idx"), label.alias("chapter"), text.alias("chunk"))

    def made(ends: Column) -> Column:
        return F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(ends) - 1)), ends, chunk_of)

    # the finished chunks are what is exploded, so that no chunk's row drags the book along
    t = books.select("book_id", *carry, F.posexplode(T.let(ends, made)).alias("__k", "__c"))
    return t.select("book_id", *carry, F.col("__k").cast("long").alias("chunk_id"), "__c.*")


def spans(boundaries: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book_id, chunk_id, start_idx, end_idx) from boundary rows and (book_id, n)."""
    closing = sizes.select("book_id", F.lit(2**62).alias("seq"), F.col("n").alias("boundary"))
    t = boundaries.select("book_id", F.col("seq").cast("long").alias("seq"), "boundary").unionByName(closing)
    w = Window.partitionBy("book_id").orderBy("seq")
    return t.select("book_id", (F.row_number().over(w) - 1).cast("long").alias("chunk_id"), F.lag("boundary", 1, 0).over(w).alias("start_idx"), F.col("boundary").alias("end_idx"))


def joined(paragraphs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Chunks from paragraph rows and boundaries in any order: each chunk's positions, joined to the rows by book and position.

    An empty chunk has an empty text and a null chapter.
    """
    sizes = paragraphs.groupBy("book_id").agg(F.count("*").alias("n"))
    chapter = F.col("chapter") if "chapter" in paragraphs.columns else F.lit(None).cast("string")
    rows = paragraphs.select("book_id", "para_idx", T.strip_left("text").alias("text"), chapter.alias("chapter"), F.lit(True).alias("__there"))
    last = F.least("end_idx", "n") - 1
    places = F.explode_outer(F.when(F.col("start_idx") <= last, F.sequence("start_idx", last)))
    t = spans(boundaries, sizes).join(sizes, "book_id").select("book_id", "chunk_id", "start_idx", "end_idx", places.alias("para_idx"))
    t = t.join(rows, ["book_id", "para_idx"], "left")
    pieces = F.array_sort(F.collect_list(F.when(F.col("__there"), F.struct("para_idx", "text", "chapter"))))
    t = t.groupBy("book_id", "chunk_id", "start_idx", "end_idx").agg(pieces.alias("p"))
    label = F.when(F.size("p") > 0, chapter_label(F.try_element_at("p", F.lit(1))["chapter"], F.try_element_at("p", F.lit(-1))["chapter"]))
    return t.select("book_id", "chunk_id", "start_idx", "end_idx", label.alias("chapter"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("chunk"))


def numbered(paragraphs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Adds chunk_id to paragraph rows by a running count of ascending boundaries."""
    marks = boundaries.select("book_id", F.col("boundary").alias("para_idx"), F.lit(1).cast("long").alias("cut"))
    t = paragraphs.join(marks.distinct(), ["book_id", "para_idx"], "left")
    running = Window.partitionBy("book_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("chunk_id", F.coalesce(F.sum("cut").over(running), F.lit(0))).drop("cut")


def chapters_of(numbered: DataFrame) -> DataFrame:
    """(book_id, chunk_id, chapter) from numbered paragraph rows."""
    ends = numbered.groupBy("book_id", "chunk_id").agg(F.min_by("chapter", "para_idx").alias("first"), F.max_by("chapter", "para_idx").alias("last"))
    return ends.select("book_id", "chunk_id", chapter_label(F.col("first"), F.col("last")).alias("chapter"))
