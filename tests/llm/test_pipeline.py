"""The pipeline, stage by stage against brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from fixtures import SF, edge_docs, empty_docs
from test_pairs import brute_classes
from test_rows import WORD, brute_removed, brute_targets, check_packing


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table after each stage, raw documents first."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        to = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(to)
        docs = spark.read.parquet(to)
        out.append(docs)
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay_until_the_last_stage(stages):
    assert all(t.columns == stages[0].columns and dict(t.dtypes) == dict(stages[0].dtypes) for t in stages[1:5])
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= {*stages[5].columns}


def test_documents_of_a_known_language_stay(stages):
    before, after = pairs(stages[0]), {*pairs(stages[1])}
    assert after <= {*before} and len(after) >= 0.97 * sum(1 for _, t in before if t and any(c.isalpha() for c in t))


def test_one_of_each_class_stays(stages):
    want = {int(c) for i, c in brute_classes(pairs(stages[1])) if i == c}
    assert {i for i, _ in pairs(stages[2])} == want and {*pairs(stages[2])} <= {*pairs(stages[1])}


def test_repeated_passages_are_gone(stages):
    rows = pairs(stages[2])
    want = sorted((i, " ".join(kept)) for (i, _), (_, kept) in zip(rows, brute_removed(rows), strict=True))
    assert sorted((i, " ".join(WORD.findall(t))) for i, t in pairs(stages[3])) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_sources_meet_their_targets(stages):

    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages[3].collect()]
    taken = Counter()
    for i, t in pairs(stages[4]):
        taken[i] += len(WORD.findall(t))
    size = Counter({i: len(WORD.findall(t)) for i, t, _ in rows})

    by, got = Counter(), Counter()
    for i, _, s in rows:
        by[s] += size[i]
        got[s] += taken[i]
    for s, want in brute_targets(by).items():
        assert abs(got[s] - want) <= 0.02 * want + 200
    assert all(taken[i] <= 2 * size[i] for i in taken)


def test_packed_sequences_hold_the_mix(stages):
    total, padded = check_packing(stages[5].collect(), pairs(stages[4]))
    assert padded <= 1.01 * total


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages[5].columns
    check_packing(out.collect(), pairs(stages[4]))  # the same mix, each id in one piece


def test_edge_rows_pass(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0
