"""Licence scans: texts brought to one canonical form are joined by digest to known licences.

The canonical form has lower case, no punctuation, no copyright lines, no list marks, one spelling of each word and single
spaces. Whole documents are held against whole licence texts, under any of their titles or none, and notices; so are each
line and each sentence of a line, which finds notices inside documents.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts as published, without their copyright lines.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
TEXTS = {
    "MIT": (
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n" + _WARRANTY
    ),
    "ISC": f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}",
    "0BSD": f"BSD Zero Clause License\n{_ISC_GRANT}.\n{_ISC_WARRANTY}",
    "BSD-2-Clause": "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
}
# Titles under which licence texts are published; the text may also stand without one.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License"],
    "BSD-2-Clause": ["The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License"],
    "BSD-3-Clause": ["The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD License"],
}
# Names that notices give to licences.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GPL-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GPL-3.0 License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0 License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0 License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "CC0-1.0": ["CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
SUBJECTS = ["", "This work is ", "This file is ", "This software is ", "This program is ", "This project is "]
VERBS = ["licensed under ", "released under ", "distributed under ", "available under ", "made available under "]
# Spellings that count as equal, after punctuation has become a space.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "licences": "licenses", "licencing": "licensing", "sublicence": "sublicense",
    "https": "http", "authorised": "authorized", "authorise": "authorize", "organisation": "organization",
    "organisations": "organizations", "favour": "favor", "favourite": "favorite", "honour": "honor", "behaviour": "behavior",
    "programme": "program", "acknowledgement": "acknowledgment", "judgement": "judgment", "whilst": "while",
    "noncommercial": "non commercial", "noninfringement": "non infringement", "per cent": "percent", "sub license": "sublicense",
}
#: A line that states a copyright: a sign, a year, "by" or a capitalised name follows the word. The word alone may be in the
#: middle of a sentence that was wrapped there.
_NAME = r"\p{Lu}\p{Ll}+ \p{Lu}[\p{Ll}.]"
COPYRIGHT = (
    r"^[^\p{L}\p{N}]*(?:(?i:copyright)[^\p{L}\p{N}]*(?:\((?i:c)\)|©|(?:(?i:by)\s+)?\d{4}\b|(?i:by|yyyy|year)\b|" + _NAME + r")|"
    r"(?:\((?i:c)\)|©)[^\p{L}\p{N}]*(?:(?i:copyright)\b|\d{4}\b|(?i:by)\b|" + _NAME + r")|(?i:all rights reserved))"
)
#: A number, letter or sign that opens an item of a list.
LIST_MARK = r"^\s*(?:\d{1,2}[.)]|\(?[a-zA-Z]\)|[*•·–-])\s+"
#: The end of a sentence within a line.
SENTENCE_END = r"[.!?;]+\s+"
#: Whatever is not a letter, a mark or a digit.
GAP = r"[^\p{L}\p{M}\p{N}]+"


def canonical(line: Column) -> Column:
    """Canonical form of a line; empty for a copyright line."""
    low = F.lower(F.regexp_replace(line, LIST_MARK, ""))
    plain = F.trim(F.regexp_replace(low, GAP, " "))
    spelled = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for one, other in SPELLINGS.items():
        spelled = F.replace(spelled, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other.replace(' ', '  ')} "))
    marks = " | ".join(SPELLINGS)
    spelled = F.trim(F.regexp_replace(spelled, " +", " "))
    plain = F.when(F.concat(F.lit(" "), plain, F.lit(" ")).rlike(f" (?:{marks.replace(' | ', '|')}) "), spelled).otherwise(plain)
    return F.when(line.rlike(COPYRIGHT), F.lit("")).otherwise(plain)


def listed(texts: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Licences and texts that stand for them: whole texts under each title and without one, notices, identifier lines."""
    rows = list(TEXTS.items()) + list((texts or {}).items())
    for key, titles in TITLES.items():
        _, _, body = TEXTS[key].partition("\n")
        # texts that differ in nothing but their title need it
        same = [k for k in TITLES if TEXTS[k].partition("\n")[2] == body]
        rows += [(key, f"{t}\n{body}") for t in titles] + ([(key, body)] if same == [key] else [])
    for key, names in NAMES.items():
        rows += [(key, s + v + t + n) for s, v, t, n in product(SUBJECTS, VERBS, ["", "the "], names)]
    ids = sorted({*TEXTS, *NAMES})
    ends = lambda key: ["", "-only", "-or-later"] if "GPL" in key else [""]
    return rows + [(key, f"SPDX-License-Identifier: {key}{end}") for key in ids for end in ends(key)]


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``license_id`` and ``digest`` of the licences known here and of further ``texts``: a few hundred rows."""
    rows = listed(texts)
    table = spark.createDataFrame(rows, "license_id string, text string")
    return table.select("license_id", whole_digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), canonical), lambda x: x != "")


def _sentences(text: Column) -> Column:
    """Canonical sentences of the lines that have several; short pieces, which no notice is, are left out early."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("licen[cs]ed|released|distributed|available") & x.rlike(SENTENCE_END + r"\S"))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_END)))
    return F.filter(F.transform(F.filter(parts, lambda x: F.lower(x).rlike("licensed|licenced|released|distributed|available")), canonical), lambda x: x != "")


def whole_digest(text: Column) -> Column:
    return F.md5(F.array_join(_lines(text), " ").cast("binary"))


def scan(df: DataFrame, key: str, text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and licence found: key, ``license_id``, ``whole_text`` and ``n_lines``.

    ``whole_text`` says that the entire document is the licence (or notice); ``n_lines`` counts its lines that are, and the
    sentences that are in lines of several. Both come from one join on digests. Documents without text, or without a licence, have no row; rows with an equal key
    count together. The known licences are a fixed small table, which is broadcast.
    """
    rows = df.select(F.col(f"`{key}`"), _lines(F.col(f"`{text}`")).alias("__lines"), _sentences(F.col(f"`{text}`")).alias("__sentences"))
    entire = F.struct(F.md5(F.array_join("__lines", " ").cast("binary")).alias("digest"), F.lit(1).alias("whole"))
    each = F.transform(F.concat("__lines", "__sentences"), lambda x: F.struct(F.md5(x.cast("binary")).alias("digest"), F.lit(0).alias("whole")))
    digests = rows.where(F.size("__lines") > 0).select(f"`{key}`", F.explode(F.concat(F.array(entire), each)).alias("__d"))
    digests = digests.select(f"`{key}`", "__d.*")
    found = digests.join(F.broadcast(known(df.sparkSession, texts)), "digest")
    return found.groupBy(key, "license_id").agg(
        (F.max("whole") == 1).alias("whole_text"), F.sum(1 - F.col("whole")).alias("n_lines")
    )


def scan_sql(texts: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    spelled = "' ' || replace(plain, ' ', '  ') || ' '"
    for one, other in SPELLINGS.items():
        spelled = f"replace({spelled}, ' {one.replace(' ', '  ')} ', ' {other.replace(' ', '  ')} ')"
    values = ",\n".join(f"({quoted(k)}, {quoted(t)})" for k, t in listed())

    def form(rows: str) -> str:
        return f"""(SELECT id, i, trim(regexp_replace({spelled}, ' +', ' ', 'g')) AS line FROM (
        SELECT id, i, trim(regexp_replace(lower(regexp_replace(line, {quoted(LIST_MARK)}, '')), {quoted(GAP)}, ' ', 'g')) AS plain FROM ({rows})
        WHERE NOT regexp_matches(line, {quoted(COPYRIGHT)})) WHERE plain <> '')"""

    def split(rows: str) -> str:
        return f"SELECT id, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM (SELECT id, string_split(text, chr(10)) AS s FROM {rows})"

    verbs = "regexp_matches(lower(line), '{}')"
    sentences = f"""SELECT id, 0 AS i, line FROM (SELECT id, unnest(regexp_split_to_array(line, {quoted(SENTENCE_END)})) AS line FROM ({split("numbered")})
        WHERE {verbs.format("licen[cs]ed|released|distributed|available")} AND regexp_matches(line, {quoted(SENTENCE_END + chr(92) + "S")}))
        WHERE {verbs.format("licensed|licenced|released|distributed|available")}"""
    return f"""
WITH listed(license_id, text) AS (VALUES {values}),
licensed AS (SELECT row_number() OVER () AS id, * FROM listed),
known AS (SELECT digest, min(license_id) AS license_id FROM (
    SELECT id, md5(string_agg(line, ' ' ORDER BY i)) AS digest FROM {form(split("licensed"))} GROUP BY id) JOIN licensed USING (id) GROUP BY digest),
numbered AS (SELECT row_number() OVER () AS id, doc_id, text FROM {texts}),
lines AS (SELECT * FROM {form(split("numbered"))}),
digests AS (SELECT id, md5(line) AS digest, 0 AS whole FROM lines
    UNION ALL SELECT id, md5(line), 0 FROM {form(sentences)}
    UNION ALL SELECT id, md5(string_agg(line, ' ' ORDER BY i)), 1 FROM lines GROUP BY id)
SELECT doc_id, license_id, max(whole) = 1 AS whole_text, CAST(sum(1 - whole) AS BIGINT) AS n_lines
FROM digests JOIN known USING (digest) JOIN numbered USING (id) GROUP BY doc_id, license_id"""
