"""Operator 3, licence scan by sentence rules.

A text is cut into pieces (at line ends and after . ! ?) and these into parts (after ; :
addresses and list marks); all are normalised (lower case, runs of other than a-z and 0-9
become a space, so that comment marks go). A run of parts that makes up a known licence
sentence is found, the longest first: a notice on a line of its own as well as a sentence
wrapped over many. The identifiers found, in order, form a sequence; ordered rules (whole
licence texts first, single notices last) take their identifiers out of it, so that a
sentence counts for one rule only. All of it is expressions within a row: no shuffle, no
Python.

``oracle_sql`` knows sentences of one piece only, and none of VARIANTS. It gives the same
for texts that have no others.

Edge cases: null and empty texts have no sentence and no licence; any length is one row;
a sentence that is repeated counts again; repeated rows get equal results; other columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier and normalised sentence. Every sentence holds one of CUES (tested).
SENTENCES: dict[str, str] = {
    "apache2": "licensed under the apache license version 2 0",
    "apache2-name": "apache license version 2 0",
    "apache2-may": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-name": "the mit license",
    "mit-name-paren": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd": "licensed under the bsd license",
    "bsd3": "licensed under the bsd 3 clause license",
    "gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl3-under": "licensed under the gnu general public license version 3",
    "gpl2": "this work is licensed under the gnu general public license version 2",
    "gpl-redist3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-redist2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl3": "licensed under the gnu lesser general public license version 3",
    "agpl3": "licensed under the gnu affero general public license version 3",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-under": "licensed under the mozilla public license version 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "rights": "all rights reserved",
}

#: Other wordings of known sentences, as canonical texts have them, and their identifiers.
VARIANTS: dict[str, str] = {
    "licensed under the apache license version 2 0 the license": "apache2",
    "apache license version 2 0 january 2004": "apache2-name",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-copy",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
}

#: Ordered rules: licence, identifiers that must follow each other in the sequence.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2", "apache2-may", "apache2-copy", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2", "apache2-may")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("GPL-3.0-or-later", ("gpl-redist3", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-redist2", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-redist3",)),
    ("GPL-2.0-or-later", ("gpl-redist2",)),
    ("GPL-3.0", ("gpl3",)),
    ("GPL-3.0", ("gpl3-under",)),
    ("GPL-2.0", ("gpl2",)),
    ("LGPL-3.0", ("lgpl3",)),
    ("AGPL-3.0", ("agpl3",)),
    ("MPL-2.0", ("mpl2",)),
    ("MPL-2.0", ("mpl2-under",)),
    ("Apache-2.0", ("apache2",)),
    ("Apache-2.0", ("apache2-name",)),
    ("MIT", ("mit",)),
    ("MIT", ("mit-under",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-name-paren",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD", ("bsd",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("All-Rights-Reserved", ("rights",)),
]

#: A text without one of these (in any case) has no known sentence, so it needs no lookup.
CUES = "licen|copyright|reserved|permission|warrant|redistribut|domain|software|endorse"
_SPLIT = r"([.!?])[ \t]+"
#: Ends of parts are marked by an X, which no text in lower case has.
_PARTS = r"([;:][ \t]+|://[^ \t\n]+[ \t]+|(?<=\n)[^a-z0-9\n]*[a-z0-9]{1,2}\)[ \t]+)"
_WORD_MARKS = r"(?<=\n)[ \t]*(?:dnl|rem)(?=\s)"
_OTHER = r"[^a-z0-9X\n]+"
#: A known sentence between two ends, the longest first; its words may be on several lines.
_KNOWN = "[X\n](?:" + "|".join(s.replace(" ", "[ X\n]+") for s in sorted([*SENTENCES.values(), *VARIANTS], key=len, reverse=True)) + ")(?=[X\n])"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (pieces with a letter or digit), n_known (licence sentences, wrapped or not), n_matches (rules applied), licences (in rule order, joined by commas), first_known (the piece in which the first licence sentence starts, from 0; -1: none)."""
    known = F.create_map(*[F.lit(x) for s, k in [*((s, k) for k, s in SENTENCES.items()), *VARIANTS.items()] for x in (s, k)])
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("s", F.regexp_replace("t", _SPLIT, "$1\n"))
    t = t.withColumn("n_sentences", F.size(F.filter(F.split("s", "\n"), lambda x: x.rlike("[a-zA-Z0-9]"))).cast("long"))
    z = F.regexp_replace(F.concat(F.lit("\n"), F.lower("s"), F.lit("\n")), _WORD_MARKS, "")
    z = F.regexp_replace(F.regexp_replace(z, _PARTS, "$1X"), _OTHER, " ")
    t = t.withColumn("z", F.when(F.col("t").rlike(f"(?i){CUES}"), F.regexp_replace(z, " ?([X\n]) ?", "$1")).otherwise(""))
    t = t.withColumn("m", F.regexp_extract_all("z", F.lit(_KNOWN), F.lit(0)))
    t = t.withColumn("k", F.transform("m", lambda x: F.struct(F.try_element_at(known, F.trim(F.regexp_replace(x, "[ X\n]+", " "))).alias("id"))))
    t = t.withColumn("q", F.when(F.size("k") > 0, F.concat(F.lit("|"), F.array_join(F.transform("k", lambda x: F.concat(F.lit("<"), x["id"], F.lit(">"))), "|"), F.lit("|"))).otherwise(""))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|".join(f"<{x}>" for x in ids)).alias("what")) for name, ids in RULES])
    start = F.struct(F.col("q").alias("q"), F.array().cast("array<string>").alias("l"), F.lit(0).cast("long").alias("n"))

    def step(acc, rule):
        rest = F.replace(acc["q"], rule["what"], F.lit("~"))
        hits = ((F.length(acc["q"]) - F.length(rest)) / (F.length(rule["what"]) - 1)).cast("long")
        return F.when(F.contains(acc["q"], rule["what"]), F.struct(rest.alias("q"), F.array_append(acc["l"], rule["name"]).alias("l"), (acc["n"] + hits).alias("n"))).otherwise(acc)

    # the rules are applied only to the few rows that hold a known sentence
    t = t.withColumn("f", F.when(F.col("q") != "", F.aggregate(rules, start, step)))
    above = F.substring("z", F.lit(1), F.regexp_instr("z", F.lit(_KNOWN)))  # to the start of the first
    return t.select(
        "doc_id",
        "n_sentences",
        F.size("k").cast("long").alias("n_known"),
        F.coalesce("f.n", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_distinct("f.l"), ","), F.lit("")).alias("licences"),
        F.when(F.size("k") > 0, F.size(F.split(above, "\n")) - 2).otherwise(-1).cast("long").alias("first_known"),
    )


def oracle_sql() -> str:
    """The scan of sentences of one piece in DuckDB's SQL, generated from SENTENCES and RULES."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    whats = ["|".join(f"<{x}>" for x in ids) for _, ids in RULES]
    chain = ", ".join(f"replace(q{n}, '{w}', '~') AS q{n + 1}" for n, w in enumerate(whats))
    hits = " + ".join(f"(length(q{n}) - length(q{n + 1})) // {len(w) - 1}" for n, w in enumerate(whats))
    first: dict[str, list[int]] = {}
    for n, (licence, _) in enumerate(RULES):
        first.setdefault(licence, []).append(n)
    names = ", ".join(
        f"CASE WHEN contains(q{n}, '{whats[n]}')" + "".join(f" AND NOT contains(q{m}, '{whats[m]}')" for m in first[licence] if m < n) + f" THEN '{licence}' END" for n, (licence, _) in enumerate(RULES)
    )
    return f"""
WITH known(id, n) AS (VALUES {known}),
t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM t),
c AS (SELECT doc_id, count(*) AS n_sentences FROM u WHERE regexp_matches(x, '[a-zA-Z0-9]') GROUP BY doc_id),
j AS (SELECT u.doc_id, u.i, known.id FROM u JOIN known ON trim(regexp_replace(lower(u.x), '[^a-z0-9]+', ' ', 'g')) = known.n),
g AS (SELECT doc_id, '|' || string_agg('<' || id || '>', '|' ORDER BY i) || '|' AS q0, count(*) AS n_known, min(i) AS first_known FROM j GROUP BY doc_id),
r AS (SELECT *, {chain} FROM g),
f AS (SELECT doc_id, n_known, first_known, {hits} AS n_matches, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS licences FROM r)
SELECT t.doc_id, CAST(coalesce(c.n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(f.n_known, 0) AS BIGINT) AS n_known, CAST(coalesce(f.n_matches, 0) AS BIGINT) AS n_matches,
coalesce(f.licences, '') AS licences, CAST(coalesce(f.first_known, -1) AS BIGINT) AS first_known
FROM t LEFT JOIN c ON t.doc_id = c.doc_id LEFT JOIN f ON t.doc_id = f.doc_id
"""
