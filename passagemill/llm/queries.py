"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, langid, licences, minhash, mixing, packing, quality, rules, toxicity, vectors, windows


def _held(docs: DataFrame, mod: int, rest: int) -> DataFrame:
    return docs.withColumn("held_out", common.crc_mod(mod) == rest)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(common.crc_mod(3) != 1))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return _held(told, 3, 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(common.table(spark, sf_dir, "embeddings"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod(5) != 0)
    model = quality.fit(docs, labels)
    return _held(quality.score(docs, model), 5, 0).select("doc_id", "held_out", "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.spans(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod(4) != 2)
    model = toxicity.fit(docs, labels)
    return _held(toxicity.score(docs, model), 4, 2).select("doc_id", "held_out", "score", "predicted")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(common.table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod(5) != 0)
    return rules.judge(docs, rules.fit(docs, labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_licence_scan": op3_licence_scan,
    "op4_cost_balanced_packing": op4_cost_balanced_packing,
    "op5_quality_nbsvm": op5_quality_nbsvm,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": vectors.ORACLE_SQL,
    "op3_licence_scan": licences.oracle_sql(),
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(words) - 11)) AS i)),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
hit AS (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.low < g.doc_id),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, (SELECT unnest(range(13)) AS j)),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS t FROM x LEFT JOIN cov ON x.doc_id = cov.doc_id AND x.p = cov.p WHERE cov.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
}
