"""Licence scan by canonical digest lookup.

A text is made canonical: case, punctuation and white space are levelled, copyright lines are
left out, equivalent spellings (licence and license, version 2.0 and v2) become one. The digest
of an entire canonical text is looked up among the digests of known licence texts in a hash join.
Entire texts are the document, each of its paragraphs and each of its lines, so a licence that
stands alone and a notice within a document are both found, but never a part of a sentence.

All steps are DataFrame expressions. Only units that hold one of the ``FULL_STEMS`` are made canonical;
every known text holds one, so nothing is lost. Units meet the known digests before anything is
grouped; results are grouped per id with partial aggregation.

Defined results: null and empty texts hold no licence; rows with one ``doc_id`` (also null) give
one result row, a notice in repeated rows counted in each; a licence named by several known texts
is reported once; an empty table gives no rows, an empty list of known texts finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Short public notices, with the names they use, and two short public licence texts.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"),
    "MIT": ("the MIT License", "MIT"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD-3-Clause"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "MPL-2.0"),
    "ISC": ("the ISC License", "ISC"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
}
FRAMES = (
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "This work is licensed under {}.",
    "This project is licensed under {}.",
    "License: {}",
    "SPDX-License-Identifier: {}",
)
TEXTS = {
    "MIT": """MIT License

Copyright (c) [year] [fullname]

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) [year] [fullname]

Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear
in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.""",
}
BSD_TEXT = """{title}Copyright (c) [year] [fullname]
{reserved}
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

{one}Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.

{two}Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution.

{clause}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {holder} OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_CLAUSE = """{three}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.

"""
BSD_TITLES = {
    "BSD-2-Clause": ("", "BSD 2-Clause License\n\n", "The 2-Clause BSD License\n\n"),
    "BSD-3-Clause": ("", "BSD 3-Clause License\n\n", "The 3-Clause BSD License\n\n"),
}
# MD5 of the canonical form of longer licences: entire, and without the appendix on how to apply it,
# with or without the line that ends the terms.
FULL_DIGESTS = {
    "Apache-2.0": (
        "249ce4125c16334f4847a5e3890d43b1",
        "421d51569c72a1d3c8093fec0c1db053",
        "1443cb2d91284f2f789347a7efed8d76",
    ),
    "CC0-1.0": (
        "e4f04de2af11485b221acabe39e8813a",
    ),
    "GPL-1.0": (
        "83422da07ee7e512522d4c2755525bd7",
        "c8410c79e55a5de82f7572da4569dbca",
        "2acca090d20b50a6a92b085cfb290884",
    ),
    "GPL-2.0": (
        "fbd64ea5c19c05cb1b10f651c609f15c",
        "2a192887e8885ac1457975020b95e17b",
        "798f0c1bfc62faa43ecaf698b1fd497b",
    ),
    "GPL-3.0": (
        "0cc683b4a2db8c1138503d617e46be8f",
        "2de44e44b1293624c49606b99fe9b660",
        "6eb35f495739d076c1b83bbe209b7f3f",
    ),
    "LGPL-2.0": (
        "a016ac70cf8369f620fa08034f6d3624",
        "f86a7c9d56ecc2632865f76e8dc94fb7",
        "c457d682f536840241d88305d1729ee4",
    ),
    "LGPL-2.1": (
        "17eeec5d210a737f63671bc4497eea06",
        "f6ec52bc7eed26c1b0d82517a2810cd2",
        "d6a3d29f0eee89a5b5b4f0af480c35fc",
    ),
    "LGPL-3.0": (
        "372bb695d7cea4477e001ffe3dca6543",
    ),
    "MPL-1.1": (
        "1a006c1229f8867f9dd8d33fd2641aba",
    ),
    "MPL-2.0": (
        "64cb8735b79f4391d192494999e12f73",
    ),
}
STEMS = ("licens", "licenc", "released under", "distributed under", "permission")
# The two-clause text without title holds none of these.
FULL_STEMS = (*STEMS, "redistribution and use")
GAP, MARGIN, YEAR = "[ \t\r\n]+", "[ \t*#/;-]*", "[<{\\[]?(year|yyyy|[12][0-9][0-9][0-9])"
# Applied in this order to the lower-case text, each everywhere.
LEVELLING = (
    # A notice that many texts share and that may be wrapped; lines that begin as a notice does; a
    # line of its own that begins with the word. A line within a sentence may begin with it too.
    (f"copyright{GAP}\\(c\\)[ \t\r\n0-9,]+free{GAP}software{GAP}foundation,{GAP}inc\\.,?({GAP}<https?://fsf\\.org/>)?", "\n"),
    (f"(^|\n){MARGIN}(©|(\\(c\\)|copyright[ \t,:]*(\\(c\\)|©)?)[ \t]*{YEAR}|copyright[ \t,:]*(\\(c\\)|©|by[ \t]))[^\n]*", "\n"),
    (f"(^|\n[ \t\r]*\n){MARGIN}copyright[^\n]*(\n[ \t\r]*\n|\\z)", "\n\n"),
    ("licence", "license"),
    ("organisation", "organization"),
    ("https?://", ""),
    ("[^a-z0-9À-ɏ.]+", " "),
    ("(version|ver|v)[. ]*([0-9])", "\\2"),
    ("([0-9])\\.0( |$|\\.)", "\\1\\2"),
    ("\\.", " "),
    ("(^| )the ", " "),
    (" +", " "),
)


def canonical(text: Column) -> Column:
    text = F.lower(text)
    for pattern, level in LEVELLING:
        text = F.regexp_replace(text, pattern, level.replace("\\", "$"))
    return F.trim(text)


def canonical_sql(text: str) -> str:
    """The same in plain SQL, for comparison."""
    text = f"lower({text})"
    for pattern, level in LEVELLING:
        quoted = pattern.replace("'", "''").replace("\\\\", "\\")
        text = f"regexp_replace({text}, '{quoted}', '{level}', 'g')"
    return f"trim({text})"


def known_rows() -> list[tuple[str, str]]:
    """``license, text`` of the built-in texts: a fixed, small number."""
    notices = [(k, frame.format(name)) for k, names in NAMES.items() for name in names for frame in FRAMES]
    return notices + list(TEXTS.items()) + bsd_rows()


def bsd_rows() -> list[tuple[str, str]]:
    """``license, text`` of the usual forms of the BSD texts: title, numbers, holder or owner."""
    made = []
    for name, titles in BSD_TITLES.items():
        for title in titles:
            for reserved in ("", "All rights reserved.\n"):
                for one, two, three in (("", "", ""), ("1. ", "2. ", "3. ")):
                    for holder in ("HOLDER", "OWNER"):
                        clause = BSD_CLAUSE.format(three=three) if name == "BSD-3-Clause" else ""
                        text = BSD_TEXT.format(
                            title=title, reserved=reserved, one=one, two=two, clause=clause, holder=holder
                        )
                        made.append((name, text))
    return made


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license, text, digest`` of the built-in texts; those known by digest only have no text."""
    rows = [(name, text, None) for name, text in known_rows()]
    rows += [(name, None, digest) for name, some in FULL_DIGESTS.items() for digest in some]
    return spark.createDataFrame(rows, "license string, text string, digest string")


def digests(known: DataFrame) -> DataFrame:
    """``digest, license`` of ``license, text`` rows, one licence per digest.

    A row without text may bring the digest of its canonical form in a column ``digest``.
    """
    digest = F.md5(canonical("text"))
    if "digest" in known.columns:
        digest = F.coalesce(digest, F.col("digest"))
    made = known.select("license", digest.alias("digest")).where("license IS NOT NULL AND digest IS NOT NULL")
    return made.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, license, notices, n_notices``: the licence a whole text is, those named inside."""
    stem = F.lower("text").rlike("|".join(FULL_STEMS))
    hits = docs.select("doc_id", "text").where(stem)
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit(2).alias("kind"), t.alias("unit")))
    paragraphs = F.transform(
        F.split("text", "\n[ \t\r]*\n"), lambda t: F.struct(F.lit(1).alias("kind"), t.alias("unit"))
    )
    # A line or paragraph that is the whole text, or a line that is a paragraph, is one unit.
    several = F.when(F.size(paragraphs) > 1, F.filter(paragraphs, lambda u: u.unit.contains("\n")))
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("unit")))
    units = F.concat(whole, F.coalesce(several, F.expr("array()").cast("array<struct<kind:int,unit:string>>")), lines)
    unit = hits.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")
    unit = unit.where(F.lower("unit").rlike("|".join(FULL_STEMS)))
    found = unit.select("doc_id", "kind", F.md5(canonical(F.col("unit"))).alias("digest")).join(
        digests(known), "digest"
    )
    found = found.select(
        "doc_id",
        F.when(F.col("kind") == 0, F.col("license")).alias("license"),
        F.when(F.col("kind") > 0, F.col("license")).alias("notice"),
    )
    none = F.lit(None).cast("string")
    rows = docs.select("doc_id", none.alias("license"), none.alias("notice")).union(found)
    return rows.groupBy("doc_id").agg(
        F.min("license").alias("license"),
        F.concat_ws(",", F.array_sort(F.collect_set("notice"))).alias("notices"),
        F.count("notice").alias("n_notices"),
    )


def scan_sql() -> str:
    """DuckDB SQL for ``scan`` over the table ``documents`` and the built-in texts."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in known_rows())
    listed = ", ".join(f"('{k}', '{d}')" for k, some in FULL_DIGESTS.items() for d in some)
    stem = "|".join(FULL_STEMS)
    return f"""
WITH known AS (
  SELECT digest, min(l) AS license FROM (
    SELECT l, md5({canonical_sql("t")}) AS digest FROM (VALUES {values}) v(l, t)
    UNION ALL SELECT l, d FROM (VALUES {listed}) v(l, d)) GROUP BY 1),
hits AS (
  SELECT doc_id, text, regexp_split_to_array(text, '\n[ \t\r]*\n') AS paragraphs FROM documents
  WHERE regexp_matches(lower(text), '{stem}')),
unit AS (
  SELECT doc_id, 0 AS kind, text AS unit FROM hits
  UNION ALL
  SELECT doc_id, 1, unit FROM (
    SELECT doc_id, unnest(paragraphs) AS unit FROM hits WHERE len(paragraphs) > 1) WHERE contains(unit, '\n')
  UNION ALL
  SELECT doc_id, 2, unnest(string_split(text, '\n')) FROM hits),
found AS (
  SELECT doc_id, kind, license FROM (
    SELECT doc_id, kind, md5({canonical_sql("unit")}) AS digest FROM unit
    WHERE regexp_matches(lower(unit), '{stem}')) JOIN known USING (digest)),
every AS (
  SELECT doc_id, CAST(NULL AS VARCHAR) AS license, CAST(NULL AS VARCHAR) AS notice FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN kind = 0 THEN license END, CASE WHEN kind > 0 THEN license END FROM found)
SELECT doc_id, min(license) AS license,
  coalesce(string_agg(DISTINCT notice, ',' ORDER BY notice), '') AS notices, count(notice) AS n_notices
FROM every GROUP BY doc_id
"""
