"""Rows that every operator must bear."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[(i * i + i // 7) % 24] + str(i % 1013) for i in range(30_000))

EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, "b"),
    (4, "one two three", "de", None),
    (5, " ".join(WORDS), "en", "a"),
    (6, " ".join(WORDS), "en", "b"),
    (6, " ".join(WORDS), "en", "b"),
    (7, "  " + "\n".join(WORDS), "fr", "b"),
    (8, LONG, "en", "c"),
    (9, "é ü ñ — ünïcode\x00nul　wide 中文字 𝒳", "es", "c"),
    (None, " ".join(WORDS), "en", None),
    (10, "x" * 5000, "en", ""),
    (10, "another text of the same number", "en", ""),
]
#: Names that the operators use inside.
CLASHING = ["size", "rep", "block", "bucket", "key", "shard", "mix", "n", "row", "k1", "t", "v", "class", "target", "taken", "parts", "rank", "lang_pred"]


def edge_docs(spark, rows=EDGES):
    t = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return t.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def empty_docs(spark):
    return edge_docs(spark).where("false")
