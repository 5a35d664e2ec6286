"""License scans by canonical digests.

A text is made canonical (lower case, copyright lines removed, punctuation and white space to
single spaces, equivalent spellings made one) and its SHA-256 is joined with the digests of
known licence texts. The lookup is of entire texts: that of the whole document, and that of
every line as a text of its own, which finds a notice standing on its own line in other text.

Only DataFrame expressions. Lines longer than the longest known single line cannot match and
are not hashed, so what is joined is few rows; the known digests are a small table given as
rows of (license, text).

Defined results: a null text is an empty one; a text without words has the digest of the empty
string and no licence; a notice that stands twice counts twice and is named once; a document that
is one known line is named both as a whole and by its line; texts under one digest have its first
name; texts of any length are hashed whole; rows that
repeat an id each get their own text's result; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm._common import cut, table, text_or_empty

#: More known texts than this are joined by a shuffle (about 120 bytes each).
MAX_BROADCAST_KNOWN = 100_000

#: Spellings that licence texts use alike, as words.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("sublicencing", "sublicensing"), ("sub license", "sublicense"), ("sub licensing", "sublicensing"), ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("behaviour", "behavior"),
    ("analogue", "analog"), ("centre", "center"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Known licence texts and one-line notices, by SPDX identifier.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
    ("BSD-2-Clause", _BSD_2 + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_3 + _BSD_END),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "MPL-2.0", "CC0-1.0")),
)

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    {}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details.

You should have received a copy of the {0} along with this program. If not, see <{1}://www.gnu.org/licenses/>."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."""

#: Files of this package's texts by SPDX identifier; also known up to the end of their terms.
_FILES = {
    "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-2.1-only": "LGPL-2.1",
    "LGPL-3.0-only": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0",
}
_END = "END OF TERMS AND CONDITIONS"


def further_texts() -> list[tuple[str, str]]:
    """Full licence texts and standard notices besides KNOWN, which the SQL reads and which stays as it is."""
    out = []
    for name, file in _FILES.items():
        text = pkgutil.get_data(__package__, f"texts/{file}.txt").decode()
        out.append((name, text))
        if _END in text:
            terms = text[: text.index(_END)]
            out += [(name, terms), (name, terms + _END)]
    out += [("Unlicense", _UNLICENSE)]
    out += [("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <{x}>") for x in ("http://unlicense.org", "http://unlicense.org/", "https://unlicense.org", "https://unlicense.org/")]
    out += [("BSL-1.0", _BSL)]
    for scheme in ("http", "https"):
        out += [("Apache-2.0", _APACHE_NOTICE.format(scheme)), ("MPL-2.0", _MPL_NOTICE.format(scheme))]
        out += [(f"{x}-3.0-or-later", _GNU_NOTICE.format(f"GNU {y}General Public License", scheme)) for x, y in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero "))]
    return out


_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\n]*(?:\(c\)|©|[0-9]|by )|\(c\)|©|all rights reserved)[^\n]*$"
_SEPARATORS = r"[^\p{L}\p{N}\n]+"


def _prepared(t: Column) -> Column:
    """Of a lower-case text, the words of each line with a space of their own on either side."""
    noted = F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")) | F.contains(t, F.lit("rights"))
    t = F.when(noted, F.regexp_replace(t, _COPYRIGHT, "")).otherwise(t)
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, _SEPARATORS, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in EQUIVALENT:
        if " " not in old:
            t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return t


def _joined(prepared: Column) -> Column:
    """One space between words, also across lines; there, spellings of several words become one."""
    t = F.regexp_replace(prepared, r"[ \n]+", "  ")
    for old, new in EQUIVALENT:
        if " " in old:
            t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical(text: Column | str) -> Column:
    return _joined(_prepared(F.lower(text_or_empty(text))))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license, chars, single) of the known texts; a digest once, under its first identifier."""
    rows = spark.createDataFrame([*KNOWN, *further_texts()] if known is None else list(known), "license string, text string")
    rows = rows.select("license", canonical("text").alias("c"), (~F.contains("text", F.lit("\n"))).alias("single"))
    return rows.where("c <> ''").groupBy(digest(F.col("c")).alias("digest")).agg(
        F.min("license").alias("license"), F.max(F.length("c")).alias("chars"), F.max("single").alias("single")
    )


def scan(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license, line_licenses, n_license_lines) for every row."""
    known = known_digests(docs.sparkSession) if known is None else known
    longest = known.where("single").agg(F.coalesce(F.max("chars"), F.lit(0))).first()[0]
    d = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_or_empty(text_col)).alias("__key"), F.lower(text_or_empty(text_col)).alias("t"))
    d = d.select("__id", "__key", _prepared(F.col("t")).alias("p"))
    # a line's canonical form is at least half as long as its prepared one, a few spelled-out words apart
    lines = F.filter(F.split("p", "\n"), lambda x: F.length(x) <= 2 * longest + 40)
    lines = F.filter(F.transform(lines, lambda x: _joined(x)), lambda x: (x != "") & (F.length(x) <= longest))
    d = cut(d.select("__id", "__key", digest(_joined(F.col("p"))).alias("digest"), F.transform(lines, digest).alias("lines")))
    near = F.broadcast if known.count() <= MAX_BROADCAST_KNOWN else (lambda x: x)
    whole = known.select(F.col("digest").alias("__d"), "license")
    single = known.where("single").select(F.col("digest").alias("__l"), F.col("license").alias("__line"))
    hits = d.where(F.size("lines") > 0).dropDuplicates(["__id", "__key"]).select("__id", "__key", F.explode("lines").alias("__l"))
    hits = hits.join(near(single), "__l").groupBy(F.col("__id").alias("__i"), F.col("__key").alias("__k")).agg(
        F.array_join(F.array_sort(F.collect_set("__line")), ",").alias("__names"), F.count("*").alias("__n")
    )
    out = d.join(near(whole), d["digest"] == whole["__d"], "left")
    out = out.join(hits, out["__id"].eqNullSafe(hits["__i"]) & (out["__key"] == hits["__k"]), "left")
    return out.select(
        F.col("__id").alias(id_col), "digest", "license",
        F.coalesce("__names", F.lit("")).alias("line_licenses"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_license_lines"),
    )


def op5_license_digests(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same lookup in DuckDB, the known texts given as rows."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    prepared = r"concat(' ', replace(regexp_replace(CASE WHEN contains(t, 'copyright') OR contains(t, '(c)') OR contains(t, '©') OR contains(t, 'rights') THEN regexp_replace(t, '%s', '', 'g') ELSE t END, '%s', '  ', 'g'), chr(10), ' ' || chr(10) || ' '), ' ')" % (_COPYRIGHT, _SEPARATORS)
    for old, new in EQUIVALENT:
        prepared = f"replace({prepared}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    joined = lambda x: f"trim(regexp_replace({x}, '[ \n]+', ' ', 'g'))"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
WITH k AS (SELECT * FROM (VALUES {values}) AS v(license, text)),
b AS (SELECT -1 AS kind, NULL AS doc_id, license, contains(text, chr(10)) AS many, lower(text) AS t FROM k
      UNION ALL SELECT 0, doc_id, NULL, NULL, lower(coalesce(text, '')) FROM documents),
p AS (SELECT *, {prepared} AS p FROM b),
c AS (SELECT *, {joined('p')} AS c FROM p),
known AS (SELECT sha256(c) AS d, min(license) AS license, bool_or(NOT many) AS single FROM c WHERE kind = -1 AND c <> '' GROUP BY sha256(c)),
l AS (SELECT doc_id, sha256({joined('x')}) AS d FROM (SELECT doc_id, unnest(string_split(p, chr(10))) AS x FROM c WHERE kind = 0)),
h AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n FROM l JOIN known USING (d) WHERE single GROUP BY doc_id)
SELECT c.doc_id, sha256(c) AS digest, known.license AS license, coalesce(h.names, '') AS line_licenses, CAST(coalesce(h.n, 0) AS BIGINT) AS n_license_lines
FROM c LEFT JOIN known ON sha256(c) = known.d LEFT JOIN h ON c.doc_id = h.doc_id WHERE c.kind = 0
"""


OP5_SQL = _sql()
