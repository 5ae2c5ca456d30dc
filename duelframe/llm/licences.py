"""Licence recognition by sentences: known sentences become identifiers, sequences of identifiers become licences.

A text is cut into pieces at line breaks and marks, each piece is normalised (lower case, everything but letters, digits and dots to one
space), and known licence sentences are found where they fill one piece or several in a row: licence texts are wrapped, with comment
marks, and a sentence may hold further marks. The longest is tried first. Ordered rules then read the sequence of identifiers: a rule that
finds its identifiers one after the other names a licence and uses them up, so longer texts are tried before
the single sentences they contain. A piece of no known sentence that speaks of a licence is reported as unknown.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "Apache2Notice",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "Apache2Copy",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2Limits",
    "released under the mit license": "MitNotice",
    "licensed under the mit license": "MitNotice",
    "this project is licensed under the mit license": "MitNotice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNoticeKept",
    "the software is provided as is without warranty of any kind": "AsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3Notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2OrLater",
    "this program is distributed in the hope that it will be useful but without any warranty": "GnuNoWarranty",
    "see the gnu general public license for more details": "GnuDetails",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "Lgpl21OrLater",
    "licensed under cc by nc 4.0": "CcByNc4Notice",
    "licensed under cc by 4.0": "CcBy4Notice",
    "licensed under cc by sa 4.0": "CcBySa4Notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4Notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "Mpl2Notice",
    "all rights reserved": "AllRights",
}

# Licences and the identifiers that show them, in the order they are tried.
LICENCE_RULES = (
    ("Apache-2.0", ("Apache2Notice", "Apache2Comply", "Apache2Copy", "Apache2Limits")),
    ("Apache-2.0", ("Apache2Notice", "Apache2Comply", "Apache2Copy")),
    ("Apache-2.0", ("Apache2Notice",)),
    ("MIT", ("MitNotice", "MitGrant", "MitNoticeKept", "AsIs")),
    ("MIT", ("MitGrant", "MitNoticeKept", "AsIs")),
    ("MIT", ("MitNotice",)),
    ("GPL-3.0-or-later", ("Gpl3OrLater", "GnuNoWarranty", "GnuDetails")),
    ("GPL-3.0-or-later", ("Gpl3OrLater",)),
    ("GPL-2.0-or-later", ("Gpl2OrLater", "GnuNoWarranty", "GnuDetails")),
    ("GPL-2.0-or-later", ("Gpl2OrLater",)),
    ("GPL-3.0", ("Gpl3Notice",)),
    ("LGPL-2.1-or-later", ("Lgpl21OrLater",)),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("CC-BY-NC-4.0", ("CcByNc4Notice",)),
    ("CC-BY-SA-4.0", ("CcBySa4Notice",)),
    ("CC-BY-4.0", ("CcBy4Notice",)),
    ("MPL-2.0", ("Mpl2Notice",)),
    ("Proprietary", ("AllRights",)),
)

# Whole sentences of the licence texts and notices as they are published, in usual variants.
WHOLE_SENTENCES = {
    "licensed under the apache license version 2.0 the license": "Apache2Notice",
    "the asf licenses this file to you under the apache license version 2.0 the license": "Apache2Notice",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "Apache2Copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2AsIs",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MitNoticeKept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GnuNoWarranty",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GnuNoWarranty",
    "see the gnu lesser general public license for more details": "GnuLesserDetails",
    "you should have received a copy of the gnu general public license along with this program": "GnuCopy",
    "you should have received a copy of the gnu lesser general public license along with this library": "GnuCopy",
    "if not see http www.gnu.org licenses": "GnuAddress",
    "if not see https www.gnu.org licenses": "GnuAddress",
    "if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa": "GnuAddress",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "Mpl2Copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "Mpl2Copy",
}

# Tried before the other rules. The usual line on rights above a BSD text is part of it.
WHOLE_RULES = (
    ("Apache-2.0", ("Apache2Notice", "Apache2Comply", "Apache2Copy", "Apache2AsIs", "Apache2Limits")),
    ("MIT", ("MitNotice", "MitGrant", "MitNoticeKept", "AsIs", "MitLiability")),
    ("MIT", ("AllRights", "MitGrant", "MitNoticeKept", "AsIs")),
    ("LGPL-2.1-or-later", ("Lgpl21OrLater", "GnuNoWarranty", "GnuLesserDetails")),
    ("BSD-3-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary")),
)

UNKNOWN = "Unknown"
# A sentence with one of these speaks of a licence. Texts without them are not cut into sentences.
_SPEAKS = r"(?i)licen[cs]|copyright|warrant|redistribut|all rights reserved|free software|permission is hereby"
# A sentence ends at a line break, or at a mark with white space behind it. Dots within versions end nothing.
_ENDS = r"([.!?;:])[\x20\x09-\x0D]+"


def _normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    return F.regexp_replace(plain, r"^[ .]+|[ .]+$", "")


def _known(sentence: str) -> str:
    """A pattern of a known sentence, also behind a list mark, over whole lines of flagged pieces; a new piece may begin between two words."""
    words = re.sub(r"\.(?= |$)", "", sentence).split()
    return r"(?m)^[?-](?:(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})\x20)?" + r"(?:\x20|\n[?-])".join(w.replace(".", r"\.") for w in words) + "$"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES | WHOLE_SENTENCES) -> Column:
    """Identifiers of the licence sentences of a text, in order; ``Unknown`` for pieces of others that speak of licences."""
    cut = F.split(F.regexp_replace(text, _ENDS, "$1\n"), "\n")
    # comment marks made of letters; the others are no part of normalised words
    words = lambda s: F.regexp_replace(F.regexp_replace(_normalised(s), r"^(?:dnl|rem)(?:[. ]+|$)", ""), r"\.(?= |$)", "")
    pieces = F.transform(cut, lambda s: F.struct(F.when(s.rlike(_SPEAKS), F.lit("?")).otherwise(F.lit("-")).alias("flag"), words(s).alias("words")))
    lines = F.array_join(F.transform(F.filter(pieces, lambda p: p["words"] != ""), lambda p: F.concat(p["flag"], p["words"])), "\n")
    for sentence in sorted(sentences, key=lambda s: (-len(s.split()), s)):
        lines = F.regexp_replace(lines, _known(sentence), f"@{sentences[sentence]}")
    ids = F.transform(F.split(lines, "\n"), lambda s: F.when(s.startswith("@"), F.substring(s, 2, 1 << 20)).when(s.startswith("?"), F.lit(UNKNOWN)))
    found = F.filter(ids, lambda i: i.isNotNull())
    return F.when(text.rlike(_SPEAKS.replace(" ", r"(?:[^a-z0-9]|\bdnl\b|\brem\b)+")), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES | WHOLE_SENTENCES, rules=WHOLE_RULES + LICENCE_RULES) -> DataFrame:
    """``docs`` with ``sentence_ids``, ``licences`` (arrays, in the order of text and of rules) and ``unknown_sentences``.

    NULL and empty texts have empty arrays and 0. A licence that rules find more than once is listed once. Every row is
    judged alone, whatever its length or copies, without a shuffle. Columns of ``docs`` with the new names are replaced.
    An empty table gives an empty table.
    """
    out = docs.withColumn("sentence_ids", F.coalesce(sentence_ids(F.col(text), sentences), F.array().cast("array<string>")))
    # Identifiers between spaces, two between neighbours, so that equal neighbours are both found.
    out = out.withColumn("_rest", F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")))
    out = out.withColumn("_hits", F.array().cast("array<string>"))
    state = F.struct(F.col("_rest").alias("rest"), F.col("_hits").alias("hits"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(ids) + " ").alias("ids")) for name, ids in rules])

    def step(at: Column, rule: Column) -> Column:
        hit = at["rest"].contains(rule["ids"])
        return F.struct(
            F.when(hit, F.replace(at["rest"], rule["ids"], F.lit("  "))).otherwise(at["rest"]).alias("rest"),
            F.when(hit, F.array_append(at["hits"], rule["name"])).otherwise(at["hits"]).alias("hits"),
        )

    read = F.when(F.size("sentence_ids") > 0, F.array_distinct(F.aggregate(table, state, step, lambda at: at["hits"])))
    unknown = F.size(F.filter("sentence_ids", lambda i: i == UNKNOWN))
    out = out.withColumn("licences", F.coalesce(read, F.col("_hits"))).withColumn("unknown_sentences", unknown)
    return out.drop("_rest", "_hits")


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op1_licence_sentences: licences of every document, lists joined by a comma."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
        "unknown_sentences",
    )


def _sql() -> str:
    speaks = _SPEAKS.replace("'", "''")
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    quoted = [(name, " " + "  ".join(ids) + " ") for name, ids in LICENCE_RULES]
    steps = []
    for k, (name, ids) in enumerate(quoted):
        steps.append(
            f"s{k + 1} AS (SELECT doc_id, list, CASE WHEN contains(rest, '{ids}') THEN replace(rest, '{ids}', '  ') ELSE rest END AS rest,"
            f" CASE WHEN contains(rest, '{ids}') AND NOT list_contains(hits, '{name}') THEN list_append(hits, '{name}') ELSE hits END AS hits FROM s{k})"
        )
    return rf"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10))) AS sentence,
    generate_subscripts(string_split(regexp_replace(text, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)), 1) AS place
  FROM documents WHERE regexp_matches(text, '{speaks}')),
known(words, id) AS (VALUES {known}),
plain AS (
  SELECT *, regexp_replace(regexp_replace(lower(sentence), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS words FROM cut),
named AS (
  SELECT doc_id, place, coalesce(id, CASE WHEN regexp_matches(sentence, '{speaks}') THEN '{UNKNOWN}' END) AS id
  FROM plain LEFT JOIN known USING (words)),
s0 AS (
  SELECT doc_id, list(id ORDER BY place) AS list, ' ' || string_agg(id, '  ' ORDER BY place) || ' ' AS rest, CAST([] AS VARCHAR[]) AS hits
  FROM named WHERE id IS NOT NULL GROUP BY doc_id),
{", ".join(steps)}
SELECT d.doc_id, coalesce(array_to_string(list, ','), '') AS sentence_ids, coalesce(array_to_string(hits, ','), '') AS licences,
  CAST(coalesce(len(list_filter(list, lambda x: x = '{UNKNOWN}')), 0) AS INTEGER) AS unknown_sentences
FROM documents d LEFT JOIN s{len(quoted)} USING (doc_id)
"""


SQL = _sql()
