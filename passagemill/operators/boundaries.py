"""Boundaries: where each book is cut, from a model's answers to a path of prompts.

The path depends on the data: each answer sets the next start. ``fold`` walks it inside an
expression, for a model that is itself an expression over the book's row. ``ask`` walks it in
Python, for a model that must be called; books are independent, so they run in parallel.
Both give a row for each book and neither shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions import text as T
from . import prompts
from .paragraphs import slices

#: A step of the walk as it is logged.
STEP = "struct<start_idx:bigint,shown:bigint,prompt_hash:string,reply:string,status:string,boundary:bigint>"
STEPS = pa.list_(pa.struct({"start_idx": pa.int64(), "shown": pa.int64(), "prompt_hash": pa.string(), "reply": pa.string(), "status": pa.string(), "boundary": pa.int64()}))
STEP_NAMES = [f.name for f in STEPS.value_type]
_WORDS = regex.compile(r"[^\s\x1c-\x1f]+")
_REPLY, _DIGITS = regex.compile(r"Answer: ID (\w+)"), regex.compile(r"\d+")


def largest_jump(book: dict[str, Column], start: Column, shown: Column) -> Column:
    """The built-in deterministic model: the shown row, other than the first, whose length differs most from the row above it (the first of equals); null without a candidate."""
    jumps = F.slice(book["jumps"], (start + 2).cast("int"), (shown - 1).cast("int"))
    return F.when(shown > 1, start + F.array_position(jumps, F.array_max(jumps)))


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x, i: F.when(i > 0, F.abs(F.length(x) - F.length(F.element_at(texts, F.greatest(i, F.lit(1)))))).otherwise(0).cast("long"))


def fold(books: DataFrame, model: Callable[[dict[str, Column], Column, Column], Column] = largest_jump) -> DataFrame:
    """Adds n and boundaries (ascending for a model that answers within the prompt).

    model: (columns by name, start, rows shown) to the index answered, or null for a reply
    that names none. Only starts on the path are computed.
    """
    n = F.size("texts").cast("long")
    state = F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<bigint>").alias("b"))
    starts = F.sequence(F.lit(0).cast("long"), n - T.TAIL - 1)

    def walked(before: Column) -> Column:
        def along(jumps: Column) -> Column:
            book = {**{c: F.col(c) for c in books.columns}, "n": n, "before": before, "jumps": jumps}

            def step(acc: Column, k: Column) -> Column:
                def moved(w: Column) -> Column:
                    def settle(answer: Column) -> Column:
                        on = F.greatest(k + w["grown"] - 1, k + 1)  # the + 1 guards against standing still
                        return F.struct(
                            F.coalesce(answer + 1, on).cast("long").alias("c"),
                            F.when(answer.isNull(), acc["b"]).otherwise(F.array_append(acc["b"], answer.cast("long"))).alias("b"),
                        )

                    return T.let(model(book, k, w["shown"]), settle)

                return F.when(acc["c"] != k, acc).otherwise(T.let(prompts.window_at(before, n, k), moved))

            return F.aggregate(starts, state, step, lambda a: a["b"])

        return T.let(_lengths(F.col("texts")), along)

    # sums and jumps are bound within the expression, so that a filter on the result can't copy them into its loop
    cuts = F.when(n > T.TAIL, T.let(prompts.sums_before(F.col("texts")), walked)).otherwise(F.array().cast("array<bigint>"))
    return books.withColumn("n", n).withColumn("boundaries", cuts)


def by_start(paragraphs: DataFrame, plan: DataFrame) -> DataFrame:
    """The built-in model's answer for every start, from paragraph rows: (book_id, start_idx, grown, answer)."""
    from pyspark.sql import Window

    above = F.lag("text").over(Window.partitionBy("book_id").orderBy("para_idx"))
    jumps = paragraphs.withColumn("jump", F.abs(F.length("text") - F.length(above))).select("book_id", "para_idx", "jump")
    places = F.explode(F.sequence(F.col("start_idx") + 1, F.col("start_idx") + F.col("shown") - 1))
    rows = plan.where("shown > 1").select("book_id", "start_idx", places.alias("para_idx")).join(jumps, ["book_id", "para_idx"])
    best = rows.groupBy("book_id", "start_idx").agg(F.max_by("para_idx", F.struct("jump", -F.col("para_idx"))).alias("answer"))
    return plan.select("book_id", "start_idx", "grown").join(best, ["book_id", "start_idx"], "left")


def plan_of(texts: list[str]) -> tuple[list[int], int]:
    """Words of all tagged rows above each row (and of all), as the expressions have it."""
    sums = [0]
    for t in texts:
        sums.append(sums[-1] + 2 + len(_WORDS.findall(t)))
    return sums, len(texts)


def shown_from(sums: list[int], n: int, start: int) -> tuple[int, int]:
    """(grown, shown) of the prompt from ``start``."""
    fits = 0
    while start + fits + 1 < n and sums[start + fits + 1] - sums[start] <= prompts.MOST:
        fits += 1
    grown = min(fits + 1, n - 1 - start)
    return grown, max(1, grown - 1)


def read_reply(reply: str | None) -> tuple[str, int | None]:
    """(status, index) of a reply; the same as the expressions of ``functions.text``."""
    if reply is None:
        return "model_error", None
    if reply == T.REFUSAL:
        return "refused", None
    word = _REPLY.search(reply)
    if not word:
        return "unmatched", None
    digits = _DIGITS.search(word[1])
    return ("ok", int(digits[0])) if digits and digits[0].isascii() and len(digits[0]) < 19 else ("bad_reply", None)


def walk(texts: list[str], call: Callable[[str], str | None], mode: str = "strict", repeats: int = 3, most: int | None = None, cached: dict | None = None) -> list[tuple]:
    """The steps of one book: (start, shown, prompt hash, reply, status, boundary).

    strict: an index at or below the last boundary, or beyond the book, is a bad_reply.
    compat: any index is taken as it is. A prompt of one row that gets no index is asked
    again up to ``repeats`` times, then the walk moves on (no_progress). ``most`` bounds the
    prompts of a book (prompt_cap). By default there is no bound in strict mode, whose walk
    ends by itself (each boundary is above the last one, and without one it moves on); in
    compat mode the starts that a rewind leads to again are bounded by twice the rows.
    """
    sums, n = plan_of(texts)
    steps, start, last, again = [], 0, 0, 0
    furthest, rewound = -1, 0
    while start < n - T.TAIL:
        if not again:
            rewound += start <= furthest
            furthest = max(furthest, start)
        if len(steps) >= most if most is not None else mode == "compat" and rewound > 2 * n:
            steps.append((start, 0, None, None, "prompt_cap", None))
            break
        grown, shown = shown_from(sums, n, start)
        prompt = "\n".join(f"ID {start + k}: {x}" for k, x in enumerate(texts[start : start + shown]))
        key = hashlib.sha256(prompt.encode("utf-8", "replace")).hexdigest()
        reply = (cached or {}).get((start, key)) if not again else None
        if reply is None:
            reply = call(prompts.message(prompt))
        status, at = read_reply(reply)
        if status == "ok" and mode == "strict" and not max(last, 0) < at < n:
            status, at = "bad_reply", None
        following = start + grown - 1
        if status == "ok":
            last = at if mode == "strict" else last
            following, again = at + 1, 0
        elif status == "refused":
            following, again = following + 1, 0
        elif following == start:
            again += 1
            if again > repeats:
                status, following, again = "no_progress", start + 1, 0
        steps.append((start, shown, key, reply, status, at))
        start = following
    return steps


def ask(books: DataFrame, model: models.BoundaryModel, replies: DataFrame | None = None, mode: str = "strict", repeats: int = 3, most: int | None = None) -> DataFrame:
    """Adds n, steps (the log of the walk) and boundaries, by calling ``model``; other columns stay.

    replies: (book_id, start_idx, prompt_hash, reply) of earlier runs; a prompt that is
    found there isn't sent again. Write ``reply_log`` of the result to have it.
    """
    had = f"array<{STEP}>"
    if replies is not None:
        old = replies.where(F.col("reply").isNotNull()).groupBy("book_id").agg(F.collect_list(F.struct("start_idx", "prompt_hash", "reply")).alias("__had"))
        t = books.join(old, "book_id", "left")
    else:
        t = books.withColumn("__had", F.lit(None).cast("array<struct<start_idx:bigint,prompt_hash:string,reply:string>>"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        call = models.ready(model)
        for texts, known in batches:
            for part in slices(pa.StructArray.from_arrays([texts, known], ["texts", "known"])):
                out = []
                for rows, old in zip(part.field("texts").to_pylist(), part.field("known").to_pylist(), strict=True):
                    cached = {(int(r["start_idx"]), r["prompt_hash"]): r["reply"] for r in old} if old is not None else {}
                    steps = walk([x or "" for x in rows], call, mode, repeats, most, cached)
                    out.append([dict(zip(STEP_NAMES, s, strict=True)) for s in steps])
                yield pa.array(out, STEPS)

    walked = F.arrow_udf(run, had)
    t = t.withColumn("n", F.size("texts").cast("long")).withColumn("steps", walked("texts", "__had")).drop("__had")
    return t.withColumn("boundaries", F.transform(F.filter("steps", lambda s: s["status"] == "ok"), lambda s: s["boundary"]))


def reply_log(asked: DataFrame) -> DataFrame:
    """A row for each prompt: book_id, step, start_idx, shown, prompt_hash, reply, status, boundary."""
    return asked.select("book_id", F.posexplode("steps").alias("step", "s")).select("book_id", F.col("step").cast("long").alias("step"), "s.*")


def boundary_rows(books: DataFrame) -> DataFrame:
    """(book_id, seq, boundary) without the closing one."""
    return books.select("book_id", F.posexplode("boundaries").alias("seq", "boundary")).withColumn("seq", F.col("seq").cast("long"))
