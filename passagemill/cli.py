"""Command line: ``segment`` books into chunks, ``ask`` questions about chunks, ``evaluate`` retrieval.

Without a command the arguments are those of ``segment``.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models, schemas
from .operators import boundaries, chunks, paragraphs
from .plans import ask, evaluate
from .plans.segment import asked_books
from .sources import sinks, tables

log = logging.getLogger("passagemill")


def parser() -> argparse.ArgumentParser:
    """The arguments of ``segment``."""
    p = argparse.ArgumentParser(prog="passagemill segment")
    p.add_argument("--paragraphs", required=True, help="Parquet, .csv or .xlsx with book_id, book_name, para_idx, chapter, text")
    p.add_argument("--model_type", default="lexical", choices=sorted(models.MODELS))
    p.add_argument("--mode", default="strict", choices=["strict", "compat"])
    return _shared(p)


def ask_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passagemill ask")
    p.add_argument("--chunks", required=True, help="Parquet, .csv or .xlsx with book_id, book_name, chunk_id, chapter, chunk")
    p.add_argument("--model_type", default="quoting", choices=sorted(models.QUESTION_MODELS))
    p.add_argument("--calls", type=int, default=8, help="calls at a time in each task")
    return _shared(p)


def evaluate_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passagemill evaluate")
    p.add_argument("--corpora", required=True, help="Parquet with book_id, corpus, chunk_id, text, embedding")
    p.add_argument("--queries", required=True, help="Parquet with book_id, queries, q_idx, q_vec")
    p.add_argument("--golds", required=True, help="Parquet, .csv or .xlsx with book_id, q_idx, must_contain, proposition_answer")
    p.add_argument("--methods", nargs="*", help="all if not given")
    p.add_argument("--out_path", default=".")
    return p


def _shared(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
    p.add_argument("--out_path", default=".", help="folder of the results (and of the log of a called model)")
    p.add_argument("--book_name", help="one book; all if not given")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "xlsx"])
    return p


def _write(out: DataFrame, to: str, kind: str) -> None:
    if kind == "parquet":
        sinks.write_chunks(out, to)
    elif kind == "csv":
        sinks.write_csv(out, to)
    else:
        sinks.write_excel(out.orderBy("book_id", "chunk_id"), f"{to}.xlsx")
    log.info("written to %s", to)


def _counts(rows: DataFrame, column: str) -> dict:
    """Rows by status: a few values."""
    return {r[column]: r["count"] for r in rows.groupBy(column).count().collect()}


def segment(args: argparse.Namespace, spark: SparkSession) -> None:
    rows = tables.read_any(spark, args.paragraphs, schemas.PARAGRAPHS, ["book_id", "para_idx", "text"])
    if args.book_name is not None:
        rows = tables.of_book(rows, args.book_name)
    names = rows.groupBy("book_id").agg(F.min("book_name").alias("book_name"))
    books = paragraphs.books_of_paragraphs(rows)
    if args.model_type == "lexical":
        walked = boundaries.fold(books)
    else:
        walked = asked_books(books, models.MODELS[args.model_type](), f"{args.out_path}/walk", mode=args.mode)
        log.info("prompts by status: %s", _counts(boundaries.reply_log(walked), "status"))
    out = chunks.assembled(walked).join(names, "book_id", "left")
    _write(schemas.conform(out, schemas.CHUNKS), f"{args.out_path}/chunks", args.format)


def ask_questions(args: argparse.Namespace, spark: SparkSession) -> None:
    rows = tables.read_any(spark, args.chunks, schemas.CHUNKS, ["book_id", "chunk_id", "chunk"])
    if args.book_name is not None:
        rows = tables.of_book(rows, args.book_name)
    annotated, replies = ask.generated(rows, models.QUESTION_MODELS[args.model_type](), f"{args.out_path}/replies", args.calls)
    status = F.when(F.col("reply").isNull(), "model_error").when(F.col("reply") == models.REFUSAL, "refused").otherwise("answered").alias("status")
    log.info("questions by status: %s", _counts(replies.select(status), "status"))
    _write(schemas.conform(annotated, schemas.ANNOTATED), f"{args.out_path}/questions", args.format)


def evaluate_methods(args: argparse.Namespace, spark: SparkSession) -> None:
    corpora = tables.read_parquet(spark, args.corpora, schemas.CORPORA)
    queries = tables.read_parquet(spark, args.queries, schemas.QUERIES)
    golds = tables.read_any(spark, args.golds, schemas.QUESTIONS, ["book_id", "q_idx", "must_contain"])
    means, report = evaluate.evaluate(corpora, queries, golds, args.methods)
    means.write.mode("overwrite").parquet(f"{args.out_path}/means")
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{args.out_path}/report")  # a row a k
    log.info("questions without a gold passage: %d; report written to %s/report", evaluate.rejected(golds), args.out_path)


COMMANDS = {"segment": (parser, segment), "ask": (ask_parser, ask_questions), "evaluate": (evaluate_parser, evaluate_methods)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    import sys

    argv = sys.argv[1:] if argv is None else argv
    name, rest = (argv[0], argv[1:]) if argv and argv[0] in COMMANDS else ("segment", argv)
    arguments, run = COMMANDS[name]
    args = arguments().parse_args(rest)
    run(args, spark or SparkSession.builder.appName("passagemill").getOrCreate())
    return 0


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    raise SystemExit(main())
