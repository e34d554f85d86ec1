"""Prompts: which paragraphs a model is shown from each start.

From start c the prompt grows until its estimate reaches the budget or the book's last row
but one; the row that ended the growth is left out again unless it is the only one. The
estimates add up (a tag is two words), so the growth is a count of rows within a range of
the running sum. ``planned`` has it as a window over paragraph rows, ``window_at`` as an
expression within a book row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST = T.FULL_WORDS - 1
#: A row has two words at least, so that many rows fit at most.
REACH = MOST // 2 + 1

INSTRUCTION = (
    "The document below is a list of paragraphs, each headed by its number as 'ID <number>: '. "
    "Find the first paragraph, other than the one at the top, at which the subject changes, and keep groups of moderate size. "
    "Reply with one line of the form 'Answer: ID <number>'."
)


def planned(weighed: DataFrame) -> DataFrame:
    """(book_id, start_idx, n, grown, shown, prompt_tokens) of each start: rows grown to, and rows shown."""
    book = Window.partitionBy("book_id")
    ahead = book.orderBy("before").rangeBetween(1, MOST)
    t = weighed.withColumn("fits", F.count("*").over(ahead)).withColumn("reached", F.max("before").over(ahead))
    t = t.withColumn("next", F.lead("before").over(book.orderBy("before"))).withColumn("last", F.max(F.when(F.col("para_idx") == F.col("n") - 2, F.col("before"))).over(book))
    t = t.where(F.col("para_idx") < F.col("n") - T.TAIL).withColumn("grown", F.least(F.col("fits") + 1, F.col("n") - 1 - F.col("para_idx")))
    end = F.when(F.col("grown") == 1, F.col("next")).when(F.col("grown") == F.col("fits") + 1, F.col("reached")).otherwise(F.col("last"))
    shown = F.greatest(F.lit(1), F.col("grown") - 1).alias("shown")
    return t.select("book_id", F.col("para_idx").alias("start_idx"), "n", "grown", shown, T.token_estimate(end - F.col("before")).alias("prompt_tokens"))


def _running(values: Column, first: Column) -> Column:
    """The sum of ``first`` and the values above, for each of a few values (an append copies the array)."""
    start = F.struct(first.cast("long").alias("s"), F.array().cast("array<bigint>").alias("b"))
    return F.aggregate(values, start, lambda a, w: F.struct((a["s"] + w).alias("s"), F.array_append(a["b"], a["s"]).alias("b")))["b"]


def sums_before(texts: Column) -> Column:
    """Words of all tagged rows above each row of ``texts``.

    In blocks of the square root of the rows: sums within a block and of blocks are short
    folds, so that a book of n rows takes about n^1.5 steps, not n^2.
    """
    zero = F.lit(0).cast("long")

    def summed(words: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(words))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / side).cast("int") - 1), lambda i: F.slice(words, i * side + 1, side))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, w: a + w))
            return F.flatten(F.zip_with(_running(totals, zero), blocks, lambda first, b: _running(b, first)))

        return F.when(F.size(words) > 0, T.let(blocks, joined)).otherwise(F.array().cast("array<bigint>"))

    return T.let(F.transform(texts, lambda x: T.word_count(x) + 2), summed)


def window_at(before: Column, n: Column, start: Column) -> Column:
    """Struct (grown, shown) of the prompt from ``start``."""
    here = F.element_at(before, (start + 1).cast("int"))
    fits = F.size(F.filter(F.slice(before, (start + 2).cast("int"), F.lit(REACH)), lambda p: p - here <= MOST))
    return T.let(F.least(fits + 1, n - 1 - start).cast("long"), lambda i: F.struct(i.alias("grown"), F.greatest(F.lit(1).cast("long"), i - 1).alias("shown")))


#: Starts that are planned together, with the rows that they can reach.
SEGMENT = 64


def with_prompts(books: DataFrame) -> DataFrame:
    """A row for each start of each book, with the text that is shown; nothing is shuffled.

    A book is first cut into segments of starts with the rows in their reach, so that a
    row never drags the whole book along.
    """
    t = books.withColumn("n", F.size("texts").cast("long")).where(F.col("n") > T.TAIL).withColumn("before", sums_before(F.col("texts")))
    last, reach = F.col("n") - T.TAIL - 1, F.lit(SEGMENT + REACH + 1)
    cut = lambda name, a: F.slice(name, (a + 1).cast("int"), reach).alias(name)
    segments = F.transform(F.sequence(F.lit(0).cast("long"), last, F.lit(SEGMENT).cast("long")), lambda a: F.struct(a.alias("a"), cut("texts", a), cut("before", a)))
    t = t.select("book_id", "n", F.explode(segments).alias("s"))
    a = F.col("s.a")

    def shown(k: Column) -> Column:
        def text(w: Column) -> Column:
            rows = F.transform(F.slice("s.texts", (k - a + 1).cast("int"), w["shown"].cast("int")), lambda x, i: T.tag(k + i, x))
            return F.struct(k.alias("start_idx"), F.col("n").alias("n"), w["grown"].alias("grown"), w["shown"].alias("shown"), F.array_join(rows, "\n").alias("prompt"))

        return T.let(window_at(F.col("s.before"), F.col("n") - a, k - a), text)

    return t.select("book_id", F.explode(F.transform(F.sequence(a, F.least(a + SEGMENT - 1, last)), shown)).alias("p")).select("book_id", "p.*")


def joined_prompts(tagged: DataFrame, plan: DataFrame) -> DataFrame:
    """The same text from paragraph rows: the positions shown, joined by book and position, and an ordered concatenation."""
    places = F.explode(F.sequence("start_idx", F.col("start_idx") + F.col("shown") - 1))
    inside = plan.select("book_id", "start_idx", places.alias("para_idx")).join(tagged.select("book_id", "para_idx", "tagged"), ["book_id", "para_idx"])
    pieces = F.array_sort(F.collect_list(F.struct("para_idx", "tagged")))
    return inside.groupBy("book_id", "start_idx").agg(F.array_join(F.transform(pieces, lambda x: x["tagged"]), "\n").alias("prompt"))


def message(prompt: str) -> str:
    """What a model is sent: the instruction once, then the rows."""
    return f"{INSTRUCTION}\nDocument:\n{prompt}"
