"""Text expressions: words, tags, reply and question parsing, quotes, names.

Every function takes and gives a Column, so all of it stays in the JVM. White space is
the Unicode class together with U+001C to U+001F, everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x1c-\x1f]"
WORDS = r"(?U)[^\s\x1c-\x1f]+"

#: Fixed values of the reply grammar and of the sampler.
REFUSAL = "content_flag_increment"
REPLY = r"(?U)Answer: ID (\w+)"
QUESTION_PARTS = r'(?d)Question: (.*?)\n\nAnswer: (.*?)\n\nSupporting Passage: "(.*?)"'
BUDGET = 550
TAIL = 5
LEAST_SAMPLES, MOST_SAMPLES = 80, 120


def div(a, b) -> Column:
    """Integral division."""
    return F.call_function("div", a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def word_count(text) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def token_estimate(words: Column) -> Column:
    """Words times 1.2, rounded; 12 n never ends in 5, so the rounding rule doesn't matter."""
    return div(words * 12 + 5, 10)


#: The fewest words whose estimate reaches the budget.
FULL_WORDS = next(n for n in range(BUDGET) if (12 * n + 5) // 10 >= BUDGET)


def tag(index: Column, text: Column) -> Column:
    return F.concat(F.lit("ID "), index.cast("string"), F.lit(": "), text)


def strip_tag(tagged) -> Column:
    """Takes the tag off, and the white space that follows it."""
    return F.regexp_replace(tagged, rf"(?U)^ID \d+:{SPACES}*", "")


def strip_left(text) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACES}+", "")


def strip(text) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACES}+|{SPACES}+$", "")


def reply_word(reply) -> Column:
    """The word after the first ``Answer: ID``; null without one."""
    return F.nullif(F.regexp_extract(reply, REPLY, 1), F.lit(""))


def reply_boundary(reply) -> Column:
    """The first run of digits in that word, as a number; null without one."""
    return F.regexp_extract(reply_word(reply), r"(?U)\d+", 0).try_cast("long")


def reply_status(reply) -> Column:
    """refused, unmatched, bad_reply or ok; a null reply is a model_error."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    return (
        F.when(reply.isNull(), "model_error")
        .when(reply == REFUSAL, "refused")
        .when(reply_word(reply).isNull(), "unmatched")
        .when(reply_boundary(reply).isNull(), "bad_reply")
        .otherwise("ok")
    )


def question_part(reply, part: int) -> Column:
    """Part 1 (question), 2 (answer) or 3 (quoted passage) of a reply; null if it is empty or missing."""
    return F.nullif(F.regexp_extract(reply, QUESTION_PARTS, part), F.lit(""))


def clean_quote(quote: Column) -> Column:
    """Handles ``...`` in a quoted passage: a leading one goes; five words or more before one are what stays."""
    at = F.instr(quote, "...")
    before = F.regexp_extract_all(F.left(quote, at - 1), F.lit(WORDS), F.lit(0))
    return (
        F.when(at == 0, quote)
        .when(at == 1, strip(F.substr(quote, F.lit(4))))
        .when(F.size(before) >= 5, F.array_join(before, " "))
        .otherwise(quote)
    )


def book_title(name) -> Column:
    return F.replace(F.split(name, "_-_")[0], F.lit("_"), F.lit(" "))


def book_author(name) -> Column:
    """Null where the name has no second part."""
    return F.replace(F.try_element_at(F.split(name, "_-_"), F.lit(2)), F.lit("_"), F.lit(" "))


def sample_step(n: Column) -> Column:
    """Distance of sampled rows among n, for some 80 to 120 samples."""
    return F.when(n < 2 * LEAST_SAMPLES, 1).otherwise(F.ceil(n / MOST_SAMPLES)).cast("long")
