"""The three programs from the command line, sheets, and the vendors' clients (faked)."""

import sys
from types import ModuleType, SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagemill import cli, models, schemas
from passagemill.sources import tables


def module(monkeypatch, name, **parts):
    made = ModuleType(name)
    made.__dict__.update(parts)
    monkeypatch.setitem(sys.modules, name, made)
    return made


def test_chat_client(monkeypatch):
    sent = []

    class Client:
        def __init__(self, **options):
            self.options = options
            create = lambda **call: sent.append(call) or SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content="Answer: ID 3"))])
            self.chat = SimpleNamespace(completions=SimpleNamespace(create=create))

    module(monkeypatch, "openai", OpenAI=Client)
    m = models.Patient(models.ChatModel(options={"api_key": "k"}, system="be brief"))
    m.open()
    assert m.complete("p") == "Answer: ID 3" and m.model.client.options == {"api_key": "k"}
    assert sent[0] == {"model": "gpt-3.5-turbo-0125", "temperature": 0.1, "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "p"}]}
    asker = models.QUESTION_MODELS["chatgpt"]()
    asker.open()
    asker.ask("the chunk", "Title", None)
    assert sent[1]["temperature"] == 0.3 and [x["role"] for x in sent[1]["messages"]] == ["system", "user"]
    assert '"Title" by an unknown author' in sent[1]["messages"][0]["content"] and sent[1]["messages"][1]["content"] == "Excerpt: the chunk"


def test_generative_client_refusals_and_retries(monkeypatch):
    calls = []

    class Client:
        def __init__(self, name):
            self.name = name

        def generate_content(self, **call):
            calls.append(call)
            parts = [] if "bad" in call["contents"] else [SimpleNamespace(text="fine")]
            if "down" in call["contents"] and len(calls) % 3:
                raise OSError("unavailable")
            return SimpleNamespace(candidates=[SimpleNamespace(content=SimpleNamespace(parts=parts))])

    kinds = ("DANGEROUS_CONTENT", "HATE_SPEECH", "HARASSMENT", "SEXUALLY_EXPLICIT")
    module(monkeypatch, "vertexai")
    module(monkeypatch, "vertexai.generative_models", GenerativeModel=Client, HarmBlockThreshold=SimpleNamespace(BLOCK_NONE=0), HarmCategory=SimpleNamespace(**{f"HARM_CATEGORY_{k}": k for k in kinds}))
    m = models.Patient(models.GenerativeModel(), sleep=lambda s: None)
    m.open()
    assert m.complete("good") == "fine" and m.complete("bad") == models.REFUSAL and len(calls) == 2
    assert calls[0]["safety_settings"] == dict.fromkeys(kinds, 0) and calls[0]["generation_config"] == {"temperature": 0.1}
    assert m.ask("down", "T", "A") == "fine" and len(calls) == 3
    assert m.ask("down", "T", "A") == "fine" and len(calls) == 6
    assert m.ask("bad", "T", "A") == models.REFUSAL


def test_pretrained_encoder(monkeypatch):
    import contextlib

    import numpy as np

    class Tensor:
        def __init__(self, x):
            self.x = x

        def numpy(self):
            return self.x

    def split(texts, **options):
        assert options == {"padding": True, "truncation": True, "return_tensors": "pt"}
        return {"attention_mask": Tensor(np.array([[1] * len(t.split()) + [0] * (4 - len(t.split())) for t in texts]))}

    class Net:
        def eval(self):
            return self

        def __call__(self, attention_mask):
            return SimpleNamespace(last_hidden_state=Tensor(np.arange(attention_mask.x.size * 2.0).reshape(*attention_mask.x.shape, 2)))

    module(monkeypatch, "torch", no_grad=contextlib.nullcontext)
    module(monkeypatch, "transformers", AutoTokenizer=SimpleNamespace(from_pretrained=lambda n: split), AutoModel=SimpleNamespace(from_pretrained=lambda n: Net()))
    from passagemill.operators import embed

    m = models.PretrainedEmbedder()
    m.open()
    (a, x), (b, y) = m.tokens(["one two", "one two three four"])
    assert embed.pooled(a, x) == [1.0, 2.0] and embed.pooled(b, y) == [11.0, 12.0]


def test_letter_counts():
    texts = ["abc  Zz a", "", "éa 漢字漢字 x", " ", "a\nbcd e"]
    for text, (vectors, mask) in zip(texts, models.LetterEmbedder().tokens(texts), strict=True):
        words = text.split(" ")
        assert vectors.tolist() == [[float(w.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for w in words] and mask.tolist() == [int(len(w) > 3) for w in words]


def test_sheets(spark, monkeypatch):
    sheets = {
        "p.xlsx": pd.DataFrame({"Chunk": ["one", None, "three"], "Chapter": ["c1", "c1", "c2"], "Other": 1}),
        "props.xlsx": pd.DataFrame({"Propositions": ["A is b.", "C."]}),
        "q.xlsx": pd.DataFrame({"Question": ["Who?"], "Answer": ["He."], "Chunk Must Contain": ["he came"]}),
    }
    monkeypatch.setattr(pd, "read_excel", lambda path: sheets[path])
    rows = tables.read_any(spark, "p.xlsx", schemas.PARAGRAPHS, ["book_id", "para_idx", "text"]).orderBy("para_idx").collect()
    assert [(r["book_id"], r["para_idx"], r["chapter"], r["text"]) for r in rows] == [(0, 0, "c1", "one"), (0, 1, "c1", None), (0, 2, "c2", "three")]
    assert [r["chunk"] for r in tables.read_any(spark, "p.xlsx", schemas.CHUNKS, ["chunk_id", "chunk"]).orderBy("chunk_id").collect()] == ["one", None, "three"]
    assert [r["text"] for r in tables.read_sheet(spark, "props.xlsx").orderBy("row_idx").collect()] == ["A is b.", "C."]
    assert [r["text"] for r in tables.read_excel(spark, "props.xlsx", "Propositions").orderBy("row_idx").collect()] == ["A is b.", "C."]
    q = tables.read_any(spark, "q.xlsx", schemas.QUESTIONS, ["q_idx", "must_contain"]).first()
    assert (q["q_idx"], q["question"], q["must_contain"]) == (0, "Who?", "he came")
    with pytest.raises(LookupError):
        tables.read_excel(spark, "q.xlsx", "Chunk")


def test_ask_and_evaluate(spark, tmp_path, monkeypatch):
    chunks = [(b, f"The_Book_-_Writer_{b}", i, 0, 1, "c", f'line {i} of "{b}"\nmore') for b in range(2) for i in range(200)]
    spark.createDataFrame(chunks, schemas.CHUNKS).write.parquet(str(tmp_path / "chunks"))
    assert cli.main(["ask", "--chunks", str(tmp_path / "chunks"), "--out_path", str(tmp_path / "a")], spark) == 0
    out = spark.read.parquet(str(tmp_path / "a/questions"))
    assert out.columns == schemas.ANNOTATED.names and out.count() == 400
    got = {(r["book_id"], r["chunk_id"]): r for r in out.where("question is not null").collect()}
    assert set(got) == {(b, i) for b in range(2) for i in range(0, 200, 2)}
    assert got[1, 4]["must_contain"] == "line 4 of 1" and got[1, 4]["question"] == "Where does The Book by Writer 1 speak of line?"
    assert cli.main(["ask", "--chunks", str(tmp_path / "chunks"), "--out_path", str(tmp_path / "b"), "--format", "csv", "--book_name", "The_Book_-_Writer_1"], spark) == 0
    again = spark.read.csv(str(tmp_path / "b/questions"), header=True, multiLine=True, escape='"')
    assert again.where("must_contain is not null").count() == 100
    vectors = lambda i: [1.0, float(i)]
    spark.createDataFrame([(1, c, i, f"text {i}", vectors(i)) for c in ("custom", "recursive") for i in range(30)], schemas.CORPORA).write.parquet(str(tmp_path / "corpora"))
    spark.createDataFrame([(1, "questions", 0, [0.0, 1.0])], schemas.QUERIES).write.parquet(str(tmp_path / "queries"))
    golds = spark.createDataFrame([(1, 0, "q", "a", "TEXT 28", None), (1, 1, "q", "a", None, None)], schemas.QUESTIONS)
    golds.coalesce(1).write.option("header", True).csv(str(tmp_path / "golds.csv"))
    assert cli.main(["evaluate", "--corpora", str(tmp_path / "corpora"), "--queries", str(tmp_path / "queries"), "--golds", str(tmp_path / "golds.csv"), "--out_path", str(tmp_path / "e"), "--methods", "Custom", "Langchain"], spark) == 0
    report = {r["k"]: (r["Custom"], r["Langchain"]) for r in spark.read.csv(str(tmp_path / "e/report"), header=True, inferSchema=True).collect()}
    assert report[1] == (0, 0) and report[2] == report[20] and abs(report[2][0] - 0.6309297) < 1e-6
    assert spark.read.parquet(str(tmp_path / "e/means")).where(F.col("k") == 5).count() == 2


def test_scratch_folder_is_shared_or_local(spark):
    from passagemill.sources import scratch

    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch.folder(spark, "x").startswith(named)

    def session(master, given=None):
        context = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: context))))

    assert scratch.folder(session("yarn", "hdfs://x/y/"), "t").startswith("hdfs://x/y/t-")
    with pytest.raises(RuntimeError):
        scratch.folder(session("local-cluster[2,1,512]"), "t")
    assert "passagemill-" in scratch.folder(session("local[4]"), "t")
