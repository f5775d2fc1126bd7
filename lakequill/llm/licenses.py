"""License scans by sentence rules, in DataFrame operations alone.

A text is cut into sentences, each sentence is normalised (ASCII letters lower-cased, everything
but letters and digits made one space) and looked up among known licence sentences; a known sentence
that line breaks, colons, abbreviations or an address after it divide into several is found too. What is known
leaves a sequence of identifiers, in text order; rules are ordered sequences of identifiers, tried
from the longest to the shortest at each place, and each identifier counts for one rule only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import table

# Sentences of public licences and their usual notices, as normalised, by identifier.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-notice-3": "this project is licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-2": "licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl3-notice": "licensed under the gnu lesser general public license version 3",
    "agpl3-notice": "licensed under the gnu affero general public license version 3",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-notice": "licensed under the bsd 2 clause license",
    "bsd3-notice": "licensed under the bsd 3 clause license",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc0-notice": "licensed under cc0 1 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-nd-notice": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-notice": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-notice": "licensed under cc by nc nd 4 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
}
# Ordered rules; names are SPDX identifiers, or LicenseRef- ones.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("Apache-2.0", ("apache-notice-2", "apache-use", "apache-obtain", "apache-as-is", "apache-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-notice-3",)),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-2",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-notice-2",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-notice",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-notice",)),
    ("Unlicense", ("unlicense-free",)),
    ("LicenseRef-all-rights-reserved", ("rights-reserved",)),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x01"
ENDS, LINES = r"([.!?;:])[\t-\r ]+", r"[\r\n]+[\t ]*([A-Z0-9(])"
ADDRESS = r"(?=https?://)"


def sentences(text: str):
    """Normalised sentences in order: cut after . ! ? ; : and before an address or a line that starts with a capital, digit or bracket."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), ENDS, f"$1{MARK}"), LINES, f"{MARK}$1"), ADDRESS, MARK)
    return F.transform(F.split(marked, MARK), lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))


def known_pattern(known) -> str:
    """A known sentence between marks, longest first; for each space there may be marks, where the cutter divided it."""
    return f"{MARK}(" + "|".join(s.replace(" ", f"(?: |{MARK}+)") for s in sorted(known, key=len, reverse=True)) + f")(?={MARK})"


def rule_pattern(rules=RULES) -> str:
    longest = sorted(rules, key=lambda r: -len(r[1]))  # stable: rules of a length keep their order
    return "|".join("".join(f"<{i}>" for i in ids) for _, ids in longest)


def scan(docs: DataFrame, *, text: str = "text", known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """docs with n_known, sentence_ids and licenses added.

    n_known counts the known sentences; sentence_ids has their identifiers in text order and
    licenses the distinct rule names in the order of their first match, both comma-joined. Null
    and empty texts have none of them. A matching sentence that no rule takes is in sentence_ids
    only. Rows that repeat are scanned alike; columns of docs with these names are replaced.
    """
    id_of = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    name_of = F.create_map(*[F.lit(x) for n, ids in rules for x in ("".join(f"<{i}>" for i in ids), n)])
    kept = [c for c in docs.columns if c not in ("n_known", "sentence_ids", "licenses")]
    marked = F.concat(F.lit(MARK), F.array_join(sentences(text), MARK), F.lit(MARK))
    found = F.regexp_extract_all(marked, F.lit(known_pattern(known.values())), F.lit(1))
    hits = F.transform(found, lambda s: F.regexp_replace(s, f"{MARK}+", " "))
    out = docs.select(*kept, F.coalesce(F.transform(hits, lambda s: F.element_at(id_of, s)), F.array().cast("array<string>")).alias("_ids"))
    sequence = F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    matched = F.transform(F.regexp_extract_all(sequence, F.lit(f"({rule_pattern(rules)})"), F.lit(1)), lambda m: F.element_at(name_of, m))
    return out.select(*kept, F.size("_ids").cast("long").alias("n_known"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct(matched), ",").alias("licenses"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_known", "sentence_ids", "licenses")


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


OP6_SQL = rf"""
WITH known(sentence, id) AS (VALUES {values((s, i) for i, s in SENTENCES.items())}),
rules(ids, name) AS (VALUES {values(("".join(f"<{i}>" for i in ids), n) for n, ids in RULES)}),
cut AS (
  SELECT rowid AS row, doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?;:])[\t-\r ]+', '\1' || chr(1), 'g'), '[\r\n]+[\t ]*([A-Z0-9(])', chr(1) || '\1', 'g'), chr(1)) AS parts
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), s AS (
  SELECT row, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut
), hit AS (
  SELECT row, string_agg(id, ',' ORDER BY pos) AS ids, string_agg('<' || id || '>', '' ORDER BY pos) AS seq, count(*) AS n
  FROM s JOIN known ON trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY row
), m AS (
  SELECT row, unnest(parts) AS ids, generate_subscripts(parts, 1) AS pos FROM (SELECT row, regexp_extract_all(seq, '({rule_pattern()})') AS parts FROM hit)
), l AS (
  SELECT row, string_agg(name, ',' ORDER BY pos) AS licenses FROM (
    SELECT row, name, min(pos) AS pos FROM m JOIN rules USING (ids) GROUP BY row, name) GROUP BY row
)
SELECT cut.doc_id, coalesce(n, 0) AS n_known, coalesce(hit.ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM cut LEFT JOIN hit USING (row) LEFT JOIN l USING (row)
"""
