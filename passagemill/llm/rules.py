"""Operator 10, quality rules: a learned decision list over text statistics.

The statistics are Spark expressions within a row (no shuffle, no Python on the
executors). Rules are learned by sequential covering: on the grow part of a bounded
sample of labelled statistics a conjunction of thresholds is grown by information gain,
then pruned on the other part, and kept if it is precise there; covered rows go, and the
next rule is learned. The list becomes one ordered conditional expression.

Edge cases: null and empty texts have zero words and fail the base check; a text of any
length is one row; without labelled rows of both classes the list is empty and only the
base check decides. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "exclaim_share", "upper_share"]
GRAM = 5


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also where a filter on the result is pushed down."""
    return F.transform(F.array(value), body)[0]


def _of_words(w: Column) -> Column:
    """n_words, word_chars and n_repeat_words of an array of words."""
    last = F.size(w) - GRAM
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)]))).otherwise(F.array().cast("array<bigint>"))

    def repeated(g: Column) -> Column:
        def among(s: Column) -> Column:
            twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["g"] == x["g"]))
            starts = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
            covered = lambda p: F.transform(p, lambda at, k: F.coalesce(F.least(F.lit(GRAM), F.get(p, k + 1) - at), F.lit(GRAM)))
            return F.aggregate(_let(starts, covered), F.lit(0).cast("long"), lambda a, n: a + n)

        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(pairs, among))

    return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _let(grams, repeated).alias("n_repeat_words"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less its text, with the base counts and the shares that rules may test."""
    keep = [c for c in docs.columns if c != text and c not in (*BASE, *SHARES)]
    t = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    words = F.filter(F.split("__t", common.GAP), lambda w: w != "")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(common.WORD))
    t = t.withColumn("__w", _let(words, _of_words)).withColumn("__l", _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("once"))))
    t = (
        t.withColumn("n_words", F.col("__w.n_words"))
        .withColumn("word_chars", F.col("__w.word_chars"))
        .withColumn("n_symbols", F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.col("__l.all") - F.col("__l.once")).cast("long"))
        .withColumn("n_repeat_words", F.col("__w.n_repeat_words"))
    )
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("__l.all"), F.lit(1))
    shares = {
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "exclaim_share": F.regexp_count("__t", F.lit("!")) / words,
        "upper_share": F.regexp_count("__t", F.lit(r"\p{Lu}")) / F.greatest(F.col("word_chars"), F.lit(1)),
    }
    return t.select(*[F.col(f"`{c}`") for c in keep], *BASE, *[shares[c].alias(c) for c in SHARES])


@dataclass(frozen=True)
class Rule:
    """A row is bad if every (column, '>=' or '<=', threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, row: dict) -> bool:
        return all(row[c] >= t if op == ">=" else row[c] <= t for c, op, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for c, op, t in self.conditions:
            out = out & (F.col(c) >= F.lit(float(t)) if op == ">=" else F.col(c) <= F.lit(float(t)))
        return out


def _grow(rows: list[tuple[dict, int]], columns: list[str], most: int) -> list[tuple[str, str, float]]:
    """Adds the condition of highest gain p * (log precision after - before) while it gains."""
    conditions: list[tuple[str, str, float]] = []
    left = rows
    while len(conditions) < most:
        p, n = sum(1 for _, y in left if not y), sum(1 for _, y in left if y)
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for c in columns:
            ordered = sorted((r[c], y) for r, y in left)
            for op, values in ((">=", ordered[::-1]), ("<=", ordered)):
                a = b = 0
                for k, (v, y) in enumerate(values):
                    a, b = a + (not y), b + y
                    if k + 1 < len(values) and values[k + 1][0] == v or not a or k + 1 == len(values):
                        continue
                    gain = a * (math.log2(a / (a + b)) - before)
                    if gain > best[0]:
                        best = (gain, (c, op, (v + values[k + 1][0]) / 2))
        if best[1] is None:
            break
        conditions.append(best[1])
        left = [r for r in left if Rule((best[1],)).covers(r[0])]
    return conditions


def learn(rows: list[tuple[dict, int]], columns: list[str] = SHARES, precision: float = 0.9, least: int = 3, rules: int = 12, conditions: int = 3) -> list[Rule]:
    """rows: (statistics, 1 good or 0 bad), in an order that has nothing to do with the label. Every third row prunes."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    found: list[Rule] = []
    while len(found) < rules:
        grown = _grow(grow, columns, conditions)
        if not grown:
            break

        def worth(k: int) -> tuple[float, int]:
            held = [y for r, y in prune if Rule(tuple(grown[:k])).covers(r)]
            return ((held.count(0) - held.count(1)) / len(held) if held else -1.0, -k)

        rule = Rule(tuple(grown[: max(range(1, len(grown) + 1), key=worth)]))
        both = [y for r, y in grow + prune if rule.covers(r)]
        held = [y for r, y in prune if rule.covers(r)]
        if both.count(0) < least or both.count(0) < precision * len(both) or held.count(0) < precision * len(held):
            break
        found.append(rule)
        grow, prune = [r for r in grow if not rule.covers(r[0])], [r for r in prune if not rule.covers(r[0])]
    return found


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4_000, seed: int = 23) -> list[Rule]:
    """Learns from the statistics of at most ``max_docs`` labelled rows (the documented bound); only numbers reach the driver."""
    chosen = common.chosen_labels(labels, "quality", max_docs, seed).select("doc_id", F.col("y").alias("__y"), F.col("mix").alias("__mix"))
    found = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    one = found.groupBy("__mix", "doc_id", "__y").agg(F.min(F.struct(*BASE, *SHARES)).alias("s"))  # one row an id
    rows = one.select("__mix", "doc_id", "__y", "s.*").collect()
    rows.sort(key=lambda r: (r["__mix"], r["doc_id"], r["__y"]))
    rows = [r for r in rows if not _failed(r)]
    return learn([({c: float(r[c]) for c in SHARES}, int(r["__y"])) for r in rows])


def _failed(r) -> bool:
    return r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and rule: the number of the rule that decided (null: none)."""
    t = statistics(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fired = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        fired = F.when(rules[k - 1].column(), k).otherwise(fired)
    t = t.withColumn("base_failed", failed).withColumn("rule", fired)
    return t.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
