"""The hand-derived cases of FIXTURES.md, one row each."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.functions import text as T
from passagemill.functions import vectors as V
from passagemill.operators import boundaries


def one(spark, column, **values):
    types = {str: "string", int: "bigint", float: "double"}
    kind = lambda v: types[type(v)] if v is not None and not isinstance(v, list) else "string" if v is None else "array<double>"
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("words, tokens", [(457, 548), (458, 550), (0, 0), (1, 1), (2, 2), (3, 4)])
def test_budget_edge(spark, words, tokens):
    assert one(spark, T.token_estimate(F.col("n")), n=words) == tokens
    assert T.FULL_WORDS == 458


@given(st.integers(0, 2_000_000))
def test_estimate_is_the_rounded_product(n):
    assert (12 * n + 5) // 10 == round(1.2 * n)


@pytest.mark.parametrize(
    "reply, status, at",
    [
        ("Answer: ID 0012", "ok", 12),
        ("Answer: ID X12Y34", "ok", 12),
        ("Answer: ID XXXX", "bad_reply", None),
        ("Answer: ID AB Answer: ID 7", "bad_reply", None),
        ("nothing", "unmatched", None),
        ("", "unmatched", None),
        (T.REFUSAL, "refused", None),
        (None, "model_error", None),
        ("Answer: ID é5", "ok", 5),
        ("Answer: ID ٣", "bad_reply", None),
    ],
)
def test_reply(spark, reply, status, at):
    assert one(spark, T.reply_status("r"), r=reply) == status
    assert one(spark, T.reply_boundary("r"), r=reply) == at
    assert boundaries.read_reply(reply) == (status, at)


@pytest.mark.parametrize("text, expected", [("  x", "x"), ("ID 3: y", "ID 3: y"), (" \x1c z ", "z "), ("", "")])
def test_tag_strip(spark, text, expected):
    assert one(spark, T.strip_tag(T.tag(F.lit(7), F.col("t"))), t=text) == expected


@pytest.mark.parametrize("text", ["a b", "", "  ", "a b c\x1fd", "a​b", "\x85x\x0b", "é ß　ü"])
def test_word_count_is_that_of_python(spark, text):
    assert one(spark, T.word_count("t"), t=text) == len(text.split())
    assert one(spark, T.strip("t"), t=text) == text.strip()


@pytest.mark.parametrize("n, step, samples", [(79, 1, 79), (80, 1, 80), (120, 1, 120), (121, 1, 121), (159, 1, 159), (160, 2, 80), (240, 2, 120), (241, 3, 81), (360, 3, 120), (361, 4, 91), (1000, 9, 112)])
def test_stride(spark, n, step, samples):
    assert one(spark, T.sample_step(F.col("n")), n=n) == step and math.ceil(n / step) == samples


@pytest.mark.parametrize(
    "reply, parts",
    [
        ('Question: Q\n\nAnswer: A\n\nSupporting Passage: "P"', ("Q", "A", "P")),
        ("Question: Q\n\nAnswer: A\n\nSupporting Passage: “P”", (None, None, None)),
        ('Question: Q\n\nAnswer: \n\nSupporting Passage: "P"', ("Q", None, "P")),
        ('Question: Q\nq\n\nAnswer: A\n\nSupporting Passage: "P"', (None, None, None)),
        ('Question: a\rb c\n\nAnswer: A\n\nSupporting Passage: "P"', ("a\rb c", "A", "P")),
    ],
)
def test_question_parts(spark, reply, parts):
    assert tuple(one(spark, T.question_part("r", k), r=reply) for k in (1, 2, 3)) == parts


@pytest.mark.parametrize(
    "quote, expected",
    [(None, None), ("a b", "a b"), ("... a ... b", "a ... b"), ("one two  three four five ... six", "one two three four five"), ("one two ... six", "one two ... six"), ("....x", ".x"), ("a…b", "a…b")],
)
def test_quote(spark, quote, expected):
    assert one(spark, T.clean_quote(F.col("q")), q=quote) == expected


def test_book_name(spark):
    assert one(spark, T.book_title("b"), b="A_B_-_C_D") == "A B" and one(spark, T.book_author("b"), b="A_B_-_C_D") == "C D"
    assert one(spark, T.book_author("b"), b="Alone") is None


@pytest.mark.parametrize("rank, expected", [(1, 1.0), (2, 0.630929754), (3, 0.5), (None, 0.0)])
def test_dcg(spark, rank, expected):
    r = F.lit(rank).cast("long")
    assert round(one(spark, V.dcg(r, F.lit(20))), 9) == expected
    assert one(spark, V.recall(r, F.lit(20))) == float(rank is not None)


def test_dcg_sweep_and_general_form(spark):
    assert [one(spark, V.dcg(F.lit(3), F.lit(k))) for k in (1, 2, 5, 10, 20)] == [0, 0, 0.5, 0.5, 0.5]
    assert one(spark, V.dcg_of("r"), r=[0.0, 0.0, 1.0, 0.0]) == 0.5


def test_pooling(spark):
    row = spark.createDataFrame([([[1.0, 1.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([], [])], "v array<array<double>>, m array<int>")
    assert [r["x"] for r in row.select(V.masked_mean("v", "m").alias("x")).collect()] == [[2.0, 3.0], None, None]


def test_dot_of_nan_and_null(spark):
    assert math.isnan(one(spark, V.dot("a", "b"), a=[1.0, float("nan")], b=[1.0, 1.0]))
    assert one(spark, V.dot(F.lit(None).cast("array<double>"), F.col("a")), a=[1.0]) is None
