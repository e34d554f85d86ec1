import math
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill import models
from passagemill.functions import vectors as V
from passagemill.operators import embed, questions, retrieval, splitters
from passagemill.plans import ask, evaluate


class Asker:
    def ask(self, chunk, title, author):
        n = int(chunk.split()[-1])
        if n % 3 == 1:
            return "I can't."
        quote = "..." + chunk if n % 3 == 2 else chunk
        return f'Question: {title}?\n\nAnswer: {author}.\n\nSupporting Passage: "{quote}"'


def test_generation_keeps_every_chunk(spark):
    rows = spark.range(200).select(F.lit(1).cast("long").alias("book_id"), F.lit("The_Book_-_A_Writer").alias("book_name"), F.col("id").alias("chunk_id"), F.concat(F.lit("chunk "), "id").alias("chunk"))
    out = {r["chunk_id"]: r for r in ask.generate(rows, Asker(), partitions=3).collect()}
    assert len(out) == 200
    asked = {i for i, r in out.items() if r["question"] is not None}
    assert asked == {i for i in range(0, 200, 2) if i % 3 != 1}
    assert out[0]["question"] == "The Book?" and out[0]["answer"] == "A Writer." and out[2]["must_contain"] == "chunk 2"
    assert questions.message("c", "T", "A").count("c") > 1


def ranked(spark, scores, k=20):
    corpus = spark.createDataFrame([(1, i, [float(s)]) for i, s in enumerate(scores)], "book_id bigint, chunk_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, 0, [1.0])], "book_id bigint, q_idx bigint, q_vec array<double>")
    return [r["chunk_id"] for r in retrieval.top_k(asked, corpus, k, ("book_id",)).orderBy("rank").collect()]


def test_order_of_ranks(spark):
    assert ranked(spark, [1, 3, 2]) == [1, 2, 0]
    assert ranked(spark, [5, 5, 5]) == [2, 1, 0]
    assert ranked(spark, [1, float("nan"), 2]) == [1, 2, 0]
    assert ranked(spark, range(30), 2) == [29, 28]


def test_blocks_don_t_change_the_result(spark):
    t = spark.range(60).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    asked = t.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("q_idx"), F.col("embedding").alias("q_vec"))
    one = retrieval.top_k(asked, t, 4).orderBy("q_idx", "rank").collect()
    assert one == retrieval.top_k(asked, t, 4, blocks=5).orderBy("q_idx", "rank").collect() and len(one) == 48


def first(spark, texts, gold):
    hits = spark.createDataFrame([(0, i, i + 1) for i in range(len(texts))], "q_idx bigint, chunk_id bigint, rank bigint")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "chunk_id bigint, text string")
    g = spark.createDataFrame([(0, gold)], "q_idx bigint, gold string")
    return retrieval.first_relevant(hits, t, g).first()["first_rank"]


def test_first_relevant(spark):
    assert first(spark, ["x", "a Gold b", "y", "gold"], "gOLD") == 2
    assert first(spark, ["x", "y"], "") == 1
    assert first(spark, ["x", "y"], "z") is None


def test_macro_mean_counts_books_alike(spark):
    scored = spark.createDataFrame([(1, "Custom", 1, 1.0, 1.0)] + [(2, "Custom", 1, 0.0, 0.0)] * 3, "book_id bigint, method string, k bigint, dcg double, recall double")
    means = retrieval.book_means(scored)
    assert retrieval.macro_means(means).first()["dcg"] == 0.5
    grid = retrieval.on_grid(means, spark.createDataFrame([(1,), (2,), (3,)], "book_id bigint"), retrieval.method_table(spark, ["Custom"]))
    rows = grid.collect()
    assert len(rows) == 15 and math.isnan(next(r["dcg"] for r in rows if r["book_id"] == 3 and r["k"] == 1))
    assert retrieval.macro_means(grid).where("k = 1").first()["dcg"] == 0.5


def test_unknown_method_fails(spark):
    with pytest.raises(ValueError, match="unknown method"):
        retrieval.method_table(spark, ["Other"])
    with pytest.raises(ValueError, match="unknown method"):
        retrieval.wide(spark.createDataFrame([], "k bigint, method string, dcg double"), ["Other"])


def test_evaluation_of_methods(spark):
    texts = ["alpha beta", "gamma delta", "epsilon"]
    vectors = [[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]]
    rows = [(b, c, i, texts[i], vectors[i]) for b in (1, 2) for c in ("custom", "semantic", "paragraph", "recursive", "propositions") for i in range(3)]
    corpora = spark.createDataFrame(rows, "book_id bigint, corpus string, chunk_id bigint, text string, embedding array<double>")
    asked = spark.createDataFrame([(b, q, 0, [1.0, 0.1] if q == "questions" else [0.1, 1.0]) for b in (1, 2) for q in ("questions", "hyde")], "book_id bigint, queries string, q_idx bigint, q_vec array<double>")
    golds = spark.createDataFrame([(1, 0, "BETA", "gamma"), (2, 0, "delta", "alpha"), (2, 1, None, None)], "book_id bigint, q_idx bigint, must_contain string, proposition_answer string")
    means, report = evaluate.evaluate(corpora, asked, golds)
    r = report.where("k = 1").first()
    assert (r["Custom"], r["HyDE"], r["Propositions"]) == (0.5, 0.5, 0.5)
    assert means.count() == 2 * 6 * 5 and [x["k"] for x in report.collect()] == [1, 2, 5, 10, 20]
    assert evaluate.rejected(golds) == 1


def test_embedding(spark):
    t = spark.createDataFrame([(0, "abba a zzzz"), (1, None), (2, "a b")], "id bigint, chunk string")
    out = {r["id"]: r["embedding"] for r in embed.embedded(t, models.LetterEmbedder()).collect()}
    assert out[0][:2] == [1.0, 1.0] and out[0][25] == 2.0 and out[1] is None and out[2] is None
    short = embed.embedded(t, models.LetterEmbedder(most_tokens=1)).where("id = 0").first()["embedding"]
    assert short[0] == 2.0 and short[25] == 0.0


def test_distance_breaks(spark):
    rows = spark.createDataFrame([(1, i, f"p{i}", [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(8)], "book_id bigint, para_idx bigint, text string, embedding array<double>")
    out = splitters.by_distance(rows, 0.8).orderBy("chunk_id").collect()
    assert [(r["start_idx"], r["end_idx"]) for r in out] == [(0, 4), (4, 8)] and out[0]["chunk"] == "p0\np1\np2\np3"


def test_rewriting(spark):
    t = spark.createDataFrame([(0, "a. b."), (1, None)], "id bigint, chunk string")
    out = splitters.rewritten(t, lambda x: x.split(". ")).collect()
    assert [(r["row_idx"], r["proposition"]) for r in out] == [(0, "a"), (1, "b.")]


def test_scores_rise_with_k_and_stay_in_bounds(spark):
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate([None, *range(1, 26)])], "q_idx bigint, first_rank bigint")
    rows = retrieval.at_cuts(ranks).orderBy("q_idx", "k").collect()
    for q in range(26):
        own = [r for r in rows if r["q_idx"] == q]
        assert [r["k"] for r in own] == [*retrieval.CUTS]
        for c in ("dcg", "recall"):
            assert [r[c] for r in own] == sorted(r[c] for r in own)
        assert all(0 <= r["dcg"] <= r["recall"] <= 1 for r in own)


def test_passages_are_found_in_long_texts(spark):
    long = " ".join(f"W{i}" for i in range(20_000))
    texts = [long, long.replace("W7001 ", ""), "a W7000 b", None]
    golds = ["w6999 W7000 w7001 w7002 w7003", "7000 W7001 w70", "W7000", "\u00e9", None]
    t = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    g = spark.createDataFrame(list(enumerate(golds)), "item_id bigint, passage string")
    begun = time.monotonic()
    found = {(r["item_id"], r["chunk_id"]) for r in retrieval.containing(t, g).collect()}
    assert found == {(i, j) for i, p in enumerate(golds) for j, x in enumerate(texts) if p and x and p.lower() in x.lower()}
    assert time.monotonic() - begun < 60  # a split in each turn of the loop takes minutes


def odd_vectors(spark):
    nan = float("nan")
    rows = [(i % 3, i, [math.sin(i), math.cos(i * i)]) for i in range(40)] + [(i % 3, 40 + i, [0.5, 0.5]) for i in range(6)]
    rows += [(0, 50, None), (1, 51, [1.0, None]), (1, 52, [1.0]), (2, 53, [nan, 1.0]), (None, 54, [1.0, 1.0]), (0, 55, []), (2, None, [0.1, 0.2]), (0, 56, [math.inf, -1.0])]
    corpus = spark.createDataFrame(rows, "book_id bigint, chunk_id bigint, embedding array<double>").coalesce(1)
    return corpus, corpus.where("chunk_id % 3 = 0 or chunk_id > 49").select("book_id", F.col("chunk_id").alias("q_idx"), F.col("embedding").alias("q_vec"))


@pytest.mark.parametrize("by", [(), ("book_id",)])
def test_best_of_blocks_are_the_best(spark, monkeypatch, by):
    monkeypatch.setattr(retrieval, "BEST_BLOCK", (7, 4))
    corpus, asked = odd_vectors(spark)
    rows = lambda t: sorted(map(repr, t.select("q_idx", "chunk_id", "score", "rank").collect()))
    assert rows(retrieval.top_k(asked, corpus, 9, by)) == rows(retrieval.top_k(asked, corpus, 9, by, score=V.dot("q.q_vec", "embedding")))


def test_all_pairs_have_their_score(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIR_BLOCK", (7, 4))
    corpus, asked = odd_vectors(spark)
    got = retrieval.all_scores(asked, corpus).select("q_idx", "chunk_id", "score").collect()
    want = asked.crossJoin(corpus).select("q_idx", "chunk_id", F.round(V.dot("q_vec", "embedding"), 9).alias("score")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_one_partition_and_one_book_are_dealt_to_blocks(spark):
    corpus = spark.range(4000).coalesce(1).select(F.lit(1).cast("long").alias("book_id"), F.col("id").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding"))
    asked = corpus.where("chunk_id < 100").select("book_id", F.col("chunk_id").alias("q_idx"), F.col("embedding").alias("q_vec"))

    def sizes(rows, questions):
        return pa.table({"book_id": [rows.num_rows], "q_idx": [questions.num_rows], "chunk_id": [0], "score": [0.0]})

    met = retrieval.meet(asked, corpus, sizes, ("book_id",), "q_idx", "chunk_id", (200, 30)).collect()
    assert len(met) == 80 and sum(r["book_id"] * r["q_idx"] for r in met) == 400_000
    assert max(r["book_id"] for r in met) < 400 and max(r["q_idx"] for r in met) < 60


def test_rounding_is_that_of_sql():
    assert V.rounded(V.np.array([0.5e-1, 2.5, -2.5, 1e300, -0.01]), 0).tolist() == [0.0, 3.0, -3.0, 1e300, 0.0]
    assert math.copysign(1, V.rounded(V.np.array([-1e-12]), 9)[0]) == 1
