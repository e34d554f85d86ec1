import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill import cli, models, schemas
from passagemill.operators import boundaries, chunks, paragraphs, prompts
from passagemill.plans import segment
from passagemill.sources import sinks, tables
from passagemill.streaming import segment as streaming


def books(spark, *texts, chapters=None):
    return spark.createDataFrame([(i, t, chapters) for i, t in enumerate(texts)], "book_id bigint, texts array<string>, chapters array<string>")


def grown_one_by_one(texts, c):
    """The growth as it is told: count the words of the joined rows again and again."""
    i, tokens = 0, 0
    while tokens < 550 and i + c < len(texts) - 1:
        i += 1
        tokens = round(1.2 * len("\n".join(f"ID {k}: {texts[k]}" for k in range(c, c + i)).split()))
    return i, 1 if i == 1 else i - 1


@given(st.lists(st.integers(0, 300), min_size=6, max_size=40), st.data())
def test_plan_is_the_growth(counts, data):
    texts = ["w " * n for n in counts]
    c = data.draw(st.integers(0, len(texts) - 6))
    assert boundaries.shown_from(boundaries.plan_of(texts)[0], len(texts), c) == grown_one_by_one(texts, c)


@pytest.mark.parametrize("texts, c, grown, shown", [(["a"] * 6, 0, 5, 4), (["w " * 456] + ["a"] * 9, 0, 1, 1), (["a"] * 20, 0, 19, 18)])
def test_hand_derived_windows(texts, c, grown, shown):
    assert boundaries.shown_from(boundaries.plan_of(texts)[0], len(texts), c) == (grown, shown)


def test_three_forms_of_the_plan_agree(spark):
    rng = random.Random(4)
    texts = [["w " * rng.choice([0, 1, 5, 60, 200, 455, 456, 457, 900]) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    t = books(spark, *texts)
    rows = t.select("book_id", F.posexplode("texts").alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))
    plan = prompts.planned(paragraphs.weighed(rows))
    window = {(r["book_id"], r["start_idx"]): (r["grown"], r["shown"], r["prompt_tokens"]) for r in plan.collect()}
    inside = {(r["book_id"], r["start_idx"]): (r["grown"], r["shown"], round(1.2 * len(r["prompt"].split()))) for r in prompts.with_prompts(t).collect()}
    joined = {(r["book_id"], r["start_idx"]): r["prompt"] for r in prompts.joined_prompts(paragraphs.tagged(rows), plan).collect()}
    assert window == inside and joined == {(r["book_id"], r["start_idx"]): r["prompt"] for r in prompts.with_prompts(t).collect()}
    for (b, c), (grown, shown, tokens) in window.items():
        assert (grown, shown) == grown_one_by_one(texts[b], c)
        assert shown == 1 or tokens < 550
        assert c + shown <= len(texts[b]) - 2


def walked(n, replies, **options):
    model = models.ScriptedModel(replies)
    steps = boundaries.walk(["x"] * n, model.complete, **options)
    return [s[0] for s in steps], [s[4] for s in steps], [s[5] for s in steps if s[4] == "ok"]


@pytest.mark.parametrize(
    "n, replies, starts, statuses, found",
    [
        (5, ["Answer: ID 3"], [], [], []),
        (20, [models.REFUSAL], [0], ["refused"], []),
        (20, ["none"], [0], ["unmatched"], []),
        (20, ["Answer: ID 7", "Answer: ID 12", "Answer: ID 15"], [0, 8, 13], ["ok"] * 3, [7, 12, 15]),
        (20, ["Answer: ID 0"], [0], ["bad_reply"], []),
        (20, ["Answer: ID 20"], [0], ["bad_reply"], []),
        (20, ["Answer: ID 9", "Answer: ID 4"], [0, 10], ["ok", "bad_reply"], [9]),
    ],
)
def test_walk(n, replies, starts, statuses, found):
    assert walked(n, replies) == (starts, statuses, found)


def test_standing_still_ends():
    long = ["w " * 600] * 8
    steps = boundaries.walk(long, models.ScriptedModel(["hm"]).complete, repeats=2)
    assert [s[4] for s in steps] == ["unmatched", "unmatched", "no_progress"] * 3


def test_compat_rewinds_until_the_cap():
    starts, statuses, _ = walked(20, ["Answer: ID 2"], mode="compat", most=5)
    assert starts[1:] == [3] * 5 and statuses[-1] == "prompt_cap"


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_long_rows_dont_use_up_the_prompts(spark, mode):
    texts = ["w " * (600 + i) for i in range(20)] + ["w " * (i * 7 % 13) for i in range(10)]
    t = books(spark, texts)
    asked = boundaries.ask(t, models.LexicalModel(), mode=mode).first()
    assert asked["boundaries"] == boundaries.fold(t).first()["boundaries"] and max(asked["boundaries"]) > 20
    assert len(asked["steps"]) > 2 * len(texts) and "prompt_cap" not in {s["status"] for s in asked["steps"]}


def test_compat_rewinds_end_by_default():
    for replies in (["Answer: ID 2"], ["Answer: ID 9", "Answer: ID 2"] * 500):
        steps = boundaries.walk(["x"] * 20, models.ScriptedModel(replies).complete, mode="compat")
        assert steps[-1][4] == "prompt_cap" and len(steps) <= 50


def test_replies_are_reused(spark, tmp_path):
    t = books(spark, [f"{'w ' * (i % 7)}{i}" for i in range(30)])
    first = segment.asked_books(t, models.LexicalModel(), str(tmp_path / "walk"))
    log = boundaries.reply_log(first)
    again = boundaries.ask(t, models.ScriptedModel([RuntimeError("must not be called")]), log)
    assert again.first()["boundaries"] == first.first()["boundaries"] != []


def test_patience():
    waits = []
    model = models.Patient(models.ScriptedModel([OSError("x"), OSError("y"), "Answer: ID 4"]), sleep=waits.append)
    assert model.complete("p") == "Answer: ID 4" and len(waits) == 2 and waits[1] > waits[0] / 2
    assert models.Patient(models.ScriptedModel([OSError("x")]), tries=3, sleep=waits.append).complete("p") is None
    assert models.Patient(models.ScriptedModel([IndexError("list index out of range")])).complete("p") == models.REFUSAL


def test_eager_and_lazy_agree(spark):
    rng = random.Random(9)
    texts = [["w " * rng.choice([0, 1, 5, 60, 200, 457, 700]) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    t = books(spark, *texts)
    eager = {r["book_id"]: r["boundaries"] for r in boundaries.fold(t).collect()}
    lazy = {r["book_id"]: r["boundaries"] for r in boundaries.ask(t, models.LexicalModel()).collect()}
    assert eager == lazy
    for b, cuts in eager.items():
        assert cuts == sorted({*cuts}) and all(0 < c < len(texts[b]) for c in cuts)


def test_chunks_give_back_the_book(spark):
    rng = random.Random(2)
    texts = [[f"{b}.{i} " + "w " * rng.randrange(90) for i in range(rng.randrange(1, 50))] for b in range(20)]
    rows = chunks.assembled(boundaries.fold(books(spark, *texts))).orderBy("book_id", "chunk_id").collect()
    for b, own in enumerate(texts):
        mine = [r for r in rows if r["book_id"] == b]
        assert "\n".join(r["chunk"] for r in mine) == "\n".join(own)
        assert [r["start_idx"] for r in mine] == [0, *(r["end_idx"] for r in mine[:-1])] and mine[-1]["end_idx"] == len(own)


@pytest.mark.parametrize("chapters, label, every", [("AA", "A", "A"), ("AB", "A and B", "A and B"), ("ABC", "A and C", "A and B and C"), ("ABA", "A", "A and B")])
def test_chapter_label(spark, chapters, label, every):
    t = books(spark, ["x"] * len(chapters), chapters=list(chapters)).withColumn("boundaries", F.array().cast("array<bigint>"))
    assert chunks.assembled(t).first()["chapter"] == label
    assert chunks.assembled(t, all_chapters=True).first()["chapter"] == every


def test_compat_chunks_from_an_array_or_rows(spark):
    t = books(spark, [f" row {k}" for k in range(10)]).withColumn("boundaries", F.array(F.lit(6), F.lit(4)).cast("array<bigint>"))
    one = [(r["start_idx"], r["end_idx"], r["chunk"]) for r in chunks.assembled(t).orderBy("chunk_id").collect()]
    rows = t.select("book_id", F.posexplode("texts").alias("para_idx", "text"))
    two = [(r["start_idx"], r["end_idx"], r["chunk"]) for r in chunks.joined(rows, boundaries.boundary_rows(t)).orderBy("chunk_id").collect()]
    assert one == two and [x[:2] for x in one] == [(0, 6), (6, 4), (4, 10)] and one[1][2] == "" and one[2][2].startswith("row 4\nrow 5")


def test_books_of_rows_and_of_documents_agree(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc"), (2, ""), (3, None)], "doc_id bigint, text string")
    of_docs = {r["book_id"]: r["texts"] for r in paragraphs.books_of_documents(docs).collect()}
    of_rows = {r["book_id"]: r["texts"] for r in paragraphs.books_of_paragraphs(paragraphs.explode_paragraphs(docs)).collect()}
    assert of_docs == of_rows == {1: ["a", "b", "", "c"], 2: [""]}


def test_schema_is_checked(spark):
    df = spark.createDataFrame([(1, 0, "x", 9)], "book_id int, para_idx int, text string, extra int")
    assert schemas.conform(df, schemas.PARAGRAPHS, ["book_id", "para_idx", "text"]).columns == schemas.PARAGRAPHS.names
    with pytest.raises(schemas.SchemaError):
        schemas.conform(df, schemas.PARAGRAPHS)
    with pytest.raises(schemas.SchemaError):
        schemas.conform(df.withColumn("text", F.lit(1)), schemas.PARAGRAPHS, ["text"])


def test_command_line(spark, tmp_path):
    rows = [(b, f"Book_{b}", i, "c1", f"{'w ' * (i * 13 % 50)}{i}") for b in range(2) for i in range(30)]
    spark.createDataFrame(rows, schemas.PARAGRAPHS).write.parquet(str(tmp_path / "in"))
    assert cli.main(["--paragraphs", str(tmp_path / "in"), "--out_path", str(tmp_path / "a"), "--book_name", "Book_1"], spark) == 0
    out = spark.read.parquet(str(tmp_path / "a/chunks"))
    assert out.columns == schemas.CHUNKS.names and {r["book_id"] for r in out.collect()} == {1} and out.count() > 1
    assert cli.main(["--paragraphs", str(tmp_path / "in"), "--out_path", str(tmp_path / "b"), "--format", "csv"], spark) == 0
    with pytest.raises(LookupError):
        cli.main(["--paragraphs", str(tmp_path / "in"), "--book_name", "No_Such"], spark)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--paragraphs", "x", "--model_type", "other"])


def test_stream_gives_the_chunks_of_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(b, "\n".join("w " * (i * 7 % 40) for i in range(25))) for b in range(6)], "doc_id bigint, text string")
    docs.where("doc_id < 3").write.parquet(str(tmp_path / "in"))
    folders = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    streaming.start(spark, *folders).awaitTermination()
    docs.where("doc_id >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    streaming.start(spark, *folders).awaitTermination()
    key = ["book_id", "chunk_id"]
    assert spark.read.parquet(folders[1]).orderBy(key).collect() == segment.segment_documents(docs).orderBy(key).collect()


@settings(max_examples=50)
@given(st.text(alphabet="ab \n", max_size=60), st.integers(1, 10))
def test_pieces_join_to_the_text(text, most):
    from passagemill.operators.splitters import split_text

    pieces = split_text(text, most)
    assert "".join(pieces) == text and all(0 < len(p) <= most for p in pieces)


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.range(0, 1000, numPartitions=7).select(F.col("id").alias("row_idx"), F.array(F.col("id") * 1.0, F.lit(0.5)).alias("embedding"))
    sinks.write_embedding_csv(rows, str(tmp_path / "m"))
    back = tables.read_embedding_csv(spark, str(tmp_path / "m")).collect()
    assert sorted((r["row_idx"], r["embedding"][0]) for r in back) == [(i, float(i)) for i in range(1000)]
    (tmp_path / "list.txt").write_text(" One \n\nTwo \n")
    assert [(r["row_idx"], r["book_name"]) for r in tables.read_book_list(spark, str(tmp_path / "list.txt")).orderBy("row_idx").collect()] == [(0, "One"), (2, "Two")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_book_list(spark, str(tmp_path / "none.txt"))
    parts = spark.createDataFrame([(1, 0, "a\n\"b\""), (2, 0, "c")], "book_id bigint, chunk_id bigint, chunk string")
    sinks.write_chunks(parts, str(tmp_path / "f"), by_folder=True)
    assert spark.read.parquet(str(tmp_path / "f")).where("book_id = 1").first()["chunk"] == 'a\n"b"'
    sinks.write_csv(parts, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').where("book_id = 1").first()["chunk"] == 'a\n"b"'


def test_exact_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello, world's end", "", None, "é 漢字"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, text string")
    slow = Tokenizer.from_file(path)
    want = [None if t is None else len(slow.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r["exact_tokens"] for r in paragraphs.exact_tokens(rows, path).orderBy("i").collect()] == want


def test_few_rows_are_python_objects_at_once():
    import pyarrow as pa

    texts = [None if i % 7 == 0 else "x" * (3 * i) for i in range(1000)] + ["y" * (1 << 20)] * 3
    for batch in (pa.array(texts), pa.array([t and [t] for t in texts])):
        parts = list(paragraphs.slices(batch))
        assert pa.concat_arrays(parts).equals(batch)
        assert all(len(p) <= paragraphs.SLICE_ROWS and (len(p) == 1 or p.nbytes <= paragraphs.SLICE_BYTES) for p in parts)
    assert not list(paragraphs.slices(pa.array([], pa.string())))


def test_a_large_batch_is_walked_and_counted_in_parts(spark, monkeypatch):
    import public_tokenizers

    class Lone(models.LexicalModel):
        """Counts the frames that hold a list of more than SLICE_ROWS books while it is called."""

        def complete(self, prompt):
            import sys

            frame, most = sys._getframe(), 0
            while frame := frame.f_back:
                most = max([most, *(len(v) for v in frame.f_locals.values() if isinstance(v, (list, tuple)) or type(v).__name__ == "Series")])
            return f"Answer: ID {most}"

    docs = spark.range(1000).coalesce(1).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("a b c"), 8), "\n").alias("text"))
    replies = boundaries.reply_log(boundaries.ask(paragraphs.books_of_documents(docs), Lone(), mode="compat", most=1)).select("reply").distinct().collect()
    assert all(int(r["reply"].split()[-1]) <= 100 for r in replies)
    counted = paragraphs.exact_tokens(docs.withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.col("text"))), public_tokenizers.path("byte_bpe_50k.json"))
    assert {(r["doc_id"] % 3 > 0, r["exact_tokens"] is not None) for r in counted.collect()} == {(True, True), (False, False)}
