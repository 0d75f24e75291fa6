"""Licence scans by canonical digests.

A text is brought to a canonical form: copyright lines go, A-Z become lower case, equivalent
spellings become one, punctuation and white space become single spaces. The SHA-256 of that form is
looked up among the digests of known licences: entire documents by a hash join, single lines
(notices) in a constant table. Both tables are fixed in size and made by the same rules from the
texts below and the files in ``licence_texts``; a table of further licences may be given, and is joined
without a hint, so nothing that grows with the data is broadcast.

Defined results: a null text counts as empty; a text with an empty canonical form matches nothing;
a very long text is one canonical form, whole; repeated rows are scanned alike; an empty table gives an empty one; other columns,
whatever their names, are ignored. A text known by two identifiers (a tie) has the first in order.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.session import table

#: Equivalent spellings, applied in this order to lower-case text: pattern, replacement. Patterns mean the same in Java and RE2.
SPELLINGS = (
    ("licen[cs]e", "license"),
    ("licen[cs]or", "licensor"),
    ("sub[- ]licens", "sublicens"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("customis", "customiz"),
    ("initialis", "initializ"),
    ("realis", "realiz"),
    ("favour", "favor"),
    ("colour", "color"),
    ("behaviour", "behavior"),
    ("copyright owner", "copyright holder"),
    ("non-?commercial", "noncommercial"),
    ("per ?cent", "percent"),
    ("wilful", "willful"),
    ("merchantibility", "merchantability"),
    ("http:", "https:"),
)
#: A line that begins with a copyright sign and a year, or reserves all rights.
COPYRIGHT_LINES = r"(^|\n)[\x20\t#*/;-]*((copyright[\x20\t]*)?(\(c\)|\x{A9})|copyright[\x20\t]+(\(c\)|\x{A9}|[0-9]{4}|<year>|\[yyyy\])|all rights reserved)[^\n]*"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_DISCLAIMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Entire licences: identifier, title, text. A text is known with and without its title.
TEXTS = (
    ("MIT", "MIT License", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _AS_IS),
    ("ISC", "ISC License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
""" + _DISCLAIMS),
    ("0BSD", "BSD Zero Clause License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _DISCLAIMS),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD + _BSD_3 + _BSD_END),
    ("Zlib", "zlib License", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", "The Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
""" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + """
For more information, please refer to <https://unlicense.org>"""),
)
#: Longer licences, a file each; the name is the identifier. What follows END (how to apply the licence) may be missing.
FILES, END = Path(__file__).with_name("licence_texts"), "END OF TERMS AND CONDITIONS"
#: Notices that fill a line; all of them hold the word license.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words with single spaces between them."""
    x = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINES, "\n")
    for pattern, to in SPELLINGS:
        x = F.regexp_replace(x, pattern, to)
    return F.trim(F.regexp_replace(x, BREAKS, " "))


def known(spark: SparkSession, entries: tuple[tuple[str, str], ...]) -> DataFrame:
    """(digest, licence) of (identifier, text)."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("licence"), F.lit(t).alias("text")) for i, t in entries]))
    out = spark.range(1).select(rows.alias("x")).select(F.sha2(canonical(F.col("x.text")), 256).alias("digest"), "x.licence")
    return out.groupBy("digest").agg(F.min("licence").alias("licence"))


def entire_texts() -> tuple[tuple[str, str], ...]:
    return tuple((i, t) for i, title, text in TEXTS for t in (text, f"{title}\n\n{text}"))


def long_texts() -> tuple[tuple[str, str], ...]:
    """The licences in FILES, whole and up to END, with and without that line."""
    out = []
    for file in sorted(FILES.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        body = text.partition(END)[0]
        out += [(file.stem, t) for t in ((text, body, body + END) if body != text else (text,))]
    return tuple(out)


def scan_licences(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``texts`` (licence, text): whole licences to know besides those of this module; rows with a null or an empty canonical form are ignored.

    (doc_id, digest, licence, n_notices, notices): the digest of the whole text and the licence that it is, if any; the number of lines that are known notices, and their licences, sorted, without repeats, joined by commas."""
    spark = docs.sparkSession
    notices = {r["digest"]: r["licence"] for r in known(spark, NOTICES).collect()}  # a constant of this module
    names = F.create_map(*[F.lit(x) for pair in notices.items() for x in pair])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    # every notice has the word license, so other texts need no look at their lines
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.element_at(names, F.sha2(canonical(line), 256)))
    found = F.when(F.col("text").rlike("[lL][iI][cC][eE][nN][cCsS][eE]"), F.filter(lines, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), found.alias("found"))
    whole = known(spark, entire_texts() + long_texts())
    if texts is None:
        whole = F.broadcast(whole)
    else:
        form = canonical(texts["text"].cast("string"))
        more = texts.where(texts["licence"].isNotNull() & (form != "")).select(F.sha2(form, 256).alias("digest"), texts["licence"].cast("string").alias("licence"))
        whole = whole.unionAll(more).groupBy("digest").agg(F.min("licence").alias("licence"))
    return rows.join(whole, "digest", "left").select(
        "doc_id", "digest", "licence", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices")
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, licence, n_notices, notices of every document."""
    return scan_licences(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB, from the same rules and texts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {quote(COPYRIGHT_LINES)}, chr(10), 'g')"
        for pattern, to in SPELLINGS:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"
        return f"trim(regexp_replace({x}, {quote(BREAKS)}, ' ', 'g'))"

    values = lambda entries: "VALUES " + ", ".join(f"({quote(i)}, {quote(t)})" for i, t in entries)
    return f"""
WITH notices AS (SELECT DISTINCT sha256({form('t')}) AS digest, i AS licence FROM ({values(NOTICES)}) v(i, t)),
texts AS (SELECT DISTINCT sha256({form('t')}) AS digest, i AS licence FROM ({values(entire_texts())}) v(i, t)),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT n, sha256({form('line')}) AS digest FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d WHERE regexp_matches(text, '[lL][iI][cC][eE][nN][cCsS][eE]'))),
found AS (SELECT n, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines JOIN notices USING (digest) GROUP BY n),
w AS (SELECT n, doc_id, sha256({form('text')}) AS digest FROM d)
SELECT doc_id, digest, licence, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM w LEFT JOIN texts USING (digest) LEFT JOIN found USING (n)
"""
