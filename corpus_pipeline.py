"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every stage
as Parquet in the folder that all executors share and reads it again for the next one, so a
lost executor costs a part of one stage and no lineage grows.

1. language_id: documents whose language isn't told with enough confidence go.
2. near_dedup: of each class of near-duplicate documents the one of smallest doc_id stays.
3. substring_dedup: passages of 13 words or more that a document of smaller doc_id has too
   are taken out; a document that loses nothing keeps its text as it is.
4. mixing: sources are brought to their target words; a document is left out, taken in part,
   whole, or a second time (a row each time; doc_id then repeats).
5. packing: what is left is cut into sequences of 1024 tokens.

Null and empty texts go at stage 1. An empty table gives an empty table at every stage. Rows
with a null doc_id pass stages 2 and 3 unchanged. Extra columns are kept up to stage 4.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import common, langid, minhash, mixing, packing, windows
from passagemill.sources import scratch

#: SQL can't express a learned language model and DartMinHash; tests hold each stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(common.crc_mod(3) != 1))
    return langid.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return windows.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted when the one after the next has been written."""
    to = scratch.folder(spark, "pipeline")
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (name, stage) in enumerate(STAGES, 1):
        written.append(f"{to}/{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(written[-1])
        docs = spark.read.parquet(written[-1])
        for path in written[:-2]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return docs
