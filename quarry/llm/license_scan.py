"""License scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form: lower case, lines that state a copyright
dropped, equivalent spellings unified, punctuation and white space to single
spaces.  The digests of the whole text and of each of its lines are hash-joined
with the digests of known licence texts and notices.  The known ones are a fixed
table of a few rows, which is broadcast; one row per document and one per match
are shuffled.

Known are the notices and short texts of ``KNOWN`` and the full texts in the
folder ``licenses``, with and without their usual title.  The oracle SQL knows
``KNOWN`` only; a text that is one of the others is null there.

Defined cases: a null, empty or blank text matches nothing; repeated rows each
get their row; equal lines count each; a text that is one known notice matches
as a whole and as a line; an empty table gives an empty table; extra columns are
not carried.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, prepared

# Standard notices and short licence texts, by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
             "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
             "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
             "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
             "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
            "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

# Usual titles of full texts whose file has none.
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["The MIT License", "The MIT License (MIT)"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
}

# Steps to the canonical form, in this order; each works on the text in lower case and keeps line ends.
STEPS = [
    (r"(?m)^[^\pL\pN\n©(]*copyright[^\pL\pN\n©(\[<{]*(?:\(c\)|©|[0-9]{4}|[\[<{](?:yyyy|year)|by\b)[^\n]*$", ""),
    (r"(?m)^[^\pL\pN\n©(]*(?:\(c\)|©)(?:[\x20\t]*[0-9]{4}[^\n]*|(?:[\x20\t]+[^\x20\t\n]+){0,4}[\x20\t]*)$", ""),
    (r"(?m)^[^\pL\pN\n]*(?:copyright|all rights reserved)[^\pL\pN\n]*$", ""),
    (r"licenc(e|ed|es|ing)\b", r"licens\1"),
    (r"\bv(?:ersion|er)?[.\x20\n]*([0-9])", r"version \1"),
    (r"(version [0-9])\.0\b", r"\1"),
    (r"\bnon[-\x20\n]+commercial", "noncommercial"),
    (r"\bsub-licens", "sublicens"),
    (r"&", " and "),
    (r"(mer)chantibility", r"\1chantability"),
    (r"[^\pL\pN\n]+", " "),
]


def canonical_lines(text: Column) -> Column:
    """The canonical form with line ends."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return out


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x20\n]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def full_texts() -> list[tuple[str, str]]:
    """Full licence texts with their usual titles, and the forms in which some are spread."""
    found = [(f.name[:-4], f.read_text("utf-8")) for f in files("quarry.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt")]
    found += [(k, body.split("\n", 1)[1]) for k, body in KNOWN if body.startswith("MIT License\n")]
    # BSD with bullets, Apache without its appendix, ISC and Unlicense in their older words.
    for name, body in list(found):
        if name.startswith("BSD-"):
            found.append((name, body.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ")))
        elif name == "Apache-2.0":
            end = body.index("END OF TERMS AND CONDITIONS")
            found += [(name, body[:end]), (name, body[:end] + "END OF TERMS AND CONDITIONS")]
        elif name == "ISC":
            found.append((name, body.replace("and/or distribute", "and distribute")))
        elif name == "Unlicense":
            found.append((name, body.replace("https://unlicense.org/", "http://unlicense.org/")))
    return found + [(name, f"{title}\n\n{body}") for name, body in found for title in TITLES.get(name, [])]


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(digest, license) of the known texts; equal canonical texts must be one licence."""
    rows = spark.createDataFrame(known, "license string, body string")
    return rows.select(digest(squeezed(canonical_lines(F.col("body")))).alias("digest"), "license").distinct()


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, text: str = "text",
                  ident: str = "doc_id") -> DataFrame:
    """Per row: id, text_hash, whole (licence of the entire text), n_lines (that are notices) and their licences."""
    spark = docs.sparkSession
    marker = spark.createDataFrame([("", None)], "digest string, license string")
    table = F.broadcast(known_digests(spark, KNOWN + full_texts() if known is None else known).union(marker))
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("text_hash"), canonical_lines(F.col(text)).alias("body"))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    probe = rows.select("id", "text_hash", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.lit("").alias("digest")),
                F.struct(F.lit(1).alias("kind"), digest(squeezed(F.col("body"))).alias("digest"))),
        F.transform(lines, lambda x: F.struct(F.lit(2).alias("kind"), digest(x).alias("digest"))))).alias("p"))
    met = probe.select("id", "text_hash", "p.kind", "p.digest").join(table, "digest")
    counted = met.groupBy("id", "text_hash").agg(
        F.count(F.when(F.col("kind") == 0, 1)).cast("int").alias("copies"),
        F.max(F.when(F.col("kind") == 1, F.col("license"))).alias("whole"),
        F.count(F.when(F.col("kind") == 2, 1)).alias("lines"), F.sort_array(F.collect_set("license")).alias("licenses"))
    # Rows that are equal were counted together.
    return counted.select("id", "text_hash", "whole", F.expr("lines div copies").cast("long").alias("n_lines"), "licenses",
                          F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(prepared(spark), sf_dir)).select(
        F.col("id").alias("doc_id"), F.col("whole").alias("whole_license"), F.col("n_lines").alias("n_notices"),
        F.array_join("licenses", ",").alias("licenses"))


def _sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


_VALUES = ", ".join("('{}', '{}')".format(k, body.replace("'", "''")) for k, body in KNOWN)
_ORACLE = f"""
WITH known AS (
  SELECT DISTINCT license, sha256(trim(regexp_replace({_sql('body')}, '[\\x20\\n]+', ' ', 'g'))) AS digest
  FROM (VALUES {_VALUES}) v(license, body)),
d AS (SELECT doc_id, {_sql('text')} AS body FROM documents),
whole AS (SELECT doc_id, max(license) AS license FROM d JOIN known
          ON known.digest = sha256(trim(regexp_replace(body, '[\\x20\\n]+', ' ', 'g'))) GROUP BY doc_id),
line AS (SELECT doc_id, license FROM (SELECT doc_id, trim(unnest(string_split(body, chr(10)))) AS x FROM d) l
         JOIN known ON known.digest = sha256(l.x) WHERE x <> ''),
notice AS (SELECT doc_id, count(*) AS n FROM line GROUP BY doc_id),
names AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses
          FROM (SELECT doc_id, license FROM line UNION SELECT doc_id, license FROM whole) GROUP BY doc_id)
SELECT d.doc_id, whole.license AS whole_license, coalesce(notice.n, 0)::BIGINT AS n_notices,
  coalesce(names.licenses, '') AS licenses
FROM d LEFT JOIN whole USING (doc_id) LEFT JOIN notice USING (doc_id) LEFT JOIN names USING (doc_id)
"""

QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE = {"op5_license_scan": _ORACLE}
