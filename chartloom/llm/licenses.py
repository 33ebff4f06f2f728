"""Licence scans by canonical digests, with DataFrame expressions only.

A text is brought to a canonical form: lower case, no copyright lines, equivalent spellings made one, punctuation and
white space one space. Its SHA-256 is joined by hash to those of known licence texts, which get the same treatment. The lines of its
canonical form are looked up in the same way, for notices within longer texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that mean the same, applied in this order to lower-case text.
SPELLINGS = [
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-commercial", "noncommercial"),
    (r"non-infringement", "noninfringement"),
    (r"per cent", "percent"),
    (r"organisation", "organization"),
    (r"authorisation", "authorization"),
    (r"favour", "favor"),
    (r"https?://", ""),
]

#: A line that only says whose copyright it is: the word or sign at its start, and a year or sign after it; or that all rights are reserved.
COPYRIGHT_LINE = r"(?dm)^[^\p{L}\p{N}\n(©]*((copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"

#: Licence texts and one-line notices, by public identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _bsd(title: str, *clauses: str, disclaimer: str = BSD_DISCLAIMER) -> list[str]:
    """A BSD licence with numbered clauses or bulleted ones, with and without titles."""
    bodies = [f"{BSD_GRANT}\n\n" + "\n\n".join(mark.format(i + 1) + c for i, c in enumerate(clauses)) + f"\n\n{disclaimer}" for mark in ("{0}. ", "* ")]
    heads = ["", f"BSD {title} License\n\n", f"The {title} BSD License\n\n"]
    return [head + body for body in bodies for head in heads]


KNOWN = [
    ("MIT", "text", MIT),
    ("MIT", "text", "MIT License\n\n" + MIT),
    ("MIT", "text", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", "text", f"{ISC_GRANT}{ISC_NOTICE}\n\n{ISC_DISCLAIMER}"),
    ("ISC", "text", f"ISC License\n\n{ISC_GRANT}{ISC_NOTICE}\n\n{ISC_DISCLAIMER}"),
    ("0BSD", "text", f"{ISC_GRANT}.\n\n{ISC_DISCLAIMER}"),
    *[("BSD-2-Clause", "text", body) for body in _bsd("2-Clause", BSD_1, BSD_2)],
    *[("BSD-3-Clause", "text", body) for body in _bsd("3-Clause", BSD_1, BSD_2, BSD_3)],
    *[("BSD-3-Clause", "text", body) for body in _bsd("3-Clause", BSD_1, BSD_2, BSD_3.replace("copyright holder", "University"), disclaimer=BSD_DISCLAIMER.replace("COPYRIGHT HOLDERS", "REGENTS").replace("COPYRIGHT HOLDER", "REGENTS"))],
    *[("Zlib", "text", head + ZLIB) for head in ("", "zlib License\n\n", "The zlib/libpng License\n\n")],
    ("Apache-2.0", "text", APACHE_HEADER),
    *[("Unlicense", "text", UNLICENSE + end) for end in ("", "\n\nFor more information, please refer to <https://unlicense.org/>", "\n\nFor more information, please refer to <https://unlicense.org>")],
    *[("BSL-1.0", "text", head + BOOST) for head in ("", "Boost Software License - Version 1.0 - August 17th, 2003\n\n")],
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "This work is dedicated to the public domain under CC0 1.0."),
]


#: SHA-256 of the canonical forms of long licence texts as published, by public identifier.
DIGESTS = [
    ("Apache-2.0", "88c09606c2f69a9a94342a32ce9835ecd1b2e54005c67cae9c6ec5e4f93cbdb0"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "d0d142139ba117e0fbb63d29df37776bc9c765c015720dc0ed43bceea6416494"),
    ("GFDL-1.3", "2cdb48855af1603586f28b20f0095e588a4bd77ee484d2c3b89bc3b1f0b61da5"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "24cd241e223e73eb1af195b9e4c0baf03a79bbbb39987eca0e347c1e490442aa"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e4d7347f1855f056365c08ad8030307f5cda3d38c9658d4f4db9a7c0aaac6c53"),
    ("MPL-2.0", "b59ad31436b35a95a00cff48e84c1f014339f59fac784c1935fc6f7dc34abf70"),
]


def canonical_lines(text: Column) -> Column:
    """The canonical form with the text's line breaks; null counts as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    return _joined(canonical_lines(text))


def _joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licenses(spark: SparkSession, rows: list[tuple[str, str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(license, kind, digest, size): one row per known digest, the first license given wins; size is the canonical form's, null for given digests."""
    known = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "license string, kind string, body string, place int")
    form = canonical(F.col("body"))
    made = known.groupBy("kind", F.sha2(form, 256).alias("digest")).agg(F.min_by("license", "place").alias("license"), F.max(F.length(form)).alias("size"))
    given = spark.createDataFrame(digests, "license string, digest string").dropDuplicates(["digest"]).join(made.filter("kind = 'text'"), "digest", "left_anti")
    return made.select("license", "kind", "digest", "size").unionByName(given.select("license", F.lit("text").alias("kind"), "digest", F.lit(None).cast("int").alias("size")))


def licenses_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(license, kind, digest, size) of whole licence texts in files that are named by identifier, as a table of known ones for scan_licenses."""
    files = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("license"))
    form = canonical(F.col("value"))
    return files.groupBy(F.sha2(form, 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length(form)).alias("size")).select("license", F.lit("text").alias("kind"), "digest", "size")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_notices: int = 10_000) -> DataFrame:
    """(id, text_digest, license, notices, n_notices), one row per input row.

    license: of the whole text, null if none is known; notices: known licences of single lines, sorted, joined by
    commas, each once (empty if none); n_notices: lines that are notices, repeats counted. A null text is empty and matches nothing. All
    lines are looked at; those whose canonical form is longer than that of any notice can't be one, so they have no digest. The
    table of known texts and notices (see known_licenses) may come from the caller: the texts are joined as Spark sees fit for their size, and more than most_notices
    notices raise ValueError, since these become a constant of the plan.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    notices = known.filter("kind = 'notice'").orderBy("digest").limit(most_notices + 1).collect()
    if len(notices) > most_notices:
        raise ValueError(f"over {most_notices} notices")
    longest = max([r.size for r in notices], default=0)
    by_digest = F.create_map(*[F.lit(x) for r in notices for x in (r.digest, r.license)]) if notices else F.create_map().cast("map<string,string>")
    rows = docs.select(F.col(id_col).alias("_id"), canonical_lines(F.col(text_col)).alias("lines"))
    lines = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(1, longest))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(x, 256))), lambda x: x.isNotNull())
    scanned = rows.select("_id", F.sha2(_joined(F.col("lines")), 256).alias("text_digest"), found.alias("found"))
    texts = known.filter("kind = 'text'").select("digest", "license")
    return scanned.join(texts, scanned["text_digest"] == texts["digest"], "left").select(
        F.col("_id").alias(id_col),
        "text_digest",
        "license",
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
        F.size("found").cast("long").alias("n_notices"),
    )


def oracle_sql(rows: list[tuple[str, str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> str:
    """The same scan of documents in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def lined(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), {quote(COPYRIGHT_LINE.replace('(?dm)', '(?m)'))}, '', 'g')"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(to)}, 'g')"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    joined = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({quote(a)}, {quote(k)}, {quote(body)}, {i})" for i, (a, k, body) in enumerate(rows))
    given = ", ".join(f"({quote(a)}, 'text', {quote(d)})" for a, d in digests)
    return f"""
WITH known AS (
  SELECT kind, sha256({joined(lined("body"))}) AS digest, min_by(license, place) AS license
  FROM (VALUES {values}) v(license, kind, body, place) GROUP BY ALL
  UNION ALL SELECT kind, digest, license FROM (VALUES {given}) g(license, kind, digest)
), forms AS MATERIALIZED (
  SELECT doc_id, {lined("text")} AS form FROM documents
), texts AS (
  SELECT doc_id, sha256({joined("form")}) AS text_digest FROM forms
), lines AS (
  SELECT doc_id, trim(unnest(string_split(form, chr(10)))) AS line FROM forms
), hits AS (
  SELECT doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices, count(*) AS n_notices
  FROM lines JOIN known k ON k.kind = 'notice' AND k.digest = sha256(line)
  GROUP BY doc_id
)
SELECT t.doc_id, t.text_digest, k.license, coalesce(h.notices, '') AS notices, coalesce(h.n_notices, 0) AS n_notices
FROM texts t LEFT JOIN known k ON k.kind = 'text' AND k.digest = t.text_digest LEFT JOIN hits h USING (doc_id)
"""
