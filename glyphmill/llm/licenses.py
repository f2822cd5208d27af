"""Licence scans by canonical digest lookup, in DataFrame functions alone.

A text is brought to a canonical form (lower case, equivalent spellings, no copyright lines, no punctuation, single spaces)
and its SHA-256 is looked up among the digests of known licences by a hash join on entire texts. A document is looked up as a
whole and, since licence notices often stand at its head, paragraph by paragraph (runs of lines between blank lines) and line by line.
The known texts are a fixed table, so its side of the join is broadcast whatever the corpus, or its rows are counted first where a
folder of texts is added; only hits are regrouped. A paragraph that names its licence is known by itself.

Defined results: a null or empty text has the digest of the empty string and no licence. Rows that repeat a doc_id answer
each for themselves. A null doc_id stays null. No rows in, no rows out. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, save

#: Spellings that count as one, applied in this order to lower-case text with single spaces.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("https://", "http://"), ("(c)", ""), ("©", ""), ("copyright holder", "copyright owner"), ("&", " and "), (" per cent", " percent"), ("version ", "v"), ("whilst", "while"), ("favour", "favor")]
COPYRIGHT = r"(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE_HEAD = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {number} of the License, or (at your option) any later version."
_GNU_NAMES = [("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",))]

#: Full texts: (name, text, its paragraphs that name the licence also where other text stands around them). The public wording.
TEXTS = [
    ("MIT", _MIT, ["Permission is hereby granted, free of charge", "MIT"]),
    ("ISC", _ISC, ["Permission to use, copy, modify, and/or distribute", "ISC"]),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", "."), ["Permission to use, copy, modify, and/or distribute", "0BSD"]),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_END}", ["Redistribution and use in source and binary forms", "BSD"]),
    ("BSD-3-Clause", f"{_BSD}\n\n{_BSD_NAMES}\n\n{_BSD_END}", ["3. Neither the name of the copyright holder", "BSD-3-Clause"]),
    ("Zlib", _ZLIB, ["Permission is granted to anyone to use this software", "Zlib"]),
    ("Unlicense", _UNLICENSE, ["This is free and unencumbered software", "Unlicense"]),
    ("Apache-2.0", f"{_APACHE_HEAD}\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n{_APACHE_END}", ["Licensed under the Apache License", "Apache-2.0"]),
]
TITLES = [("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("0BSD", "BSD Zero Clause License"), ("Zlib", "zlib License")]
#: One-line notices and the usual heads of files, and identifiers that stand in a fixed line. Fixed values.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
SPDX = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "Apache-2.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"]


def _known() -> list[tuple[str, str]]:
    out = [(name, text) for name, text, _ in TEXTS] + NOTICES
    out += [(name, f"{title}\n\n{text}") for name, title in TITLES for n, text, _ in TEXTS if n == name]
    out += [(mark, part) for _, text, (start, mark) in TEXTS for part in text.split("\n\n") if part.startswith(start)]
    out += [(name.removesuffix("-only") if name.startswith("GPL") else name, f"SPDX-License-Identifier: {name}") for name in SPDX]
    for short, name, numbers in _GNU_NAMES:
        for number in numbers:
            label = f"{short}-{number if '.' in number else number + '.0'}-or-later"
            for what in ("program", "library", "software", "file"):
                out += [(label, _GNU.format(what=what, mark=mark, name=name, comma=comma, number=number)) for mark, comma in ((":", ","), (";", ";"), (";", ","))]
    return list(dict.fromkeys(out))


#: Known licences: (name, text).
KNOWN = _known()
#: Words of which every known text has one, in some spelling.
HINT = "licen[sc]e|permission|permitted|unencumbered"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    t = F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[ !-/:-@\[-`{-~]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def from_folder(spark, path: str) -> DataFrame:
    """(license, text) of a folder of licence texts, one file each, named by the file: more known texts for scan."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("license"), F.col("value").alias("text"))
    return files.where(F.col("text").rlike("(?i)" + HINT))


def known(spark, more: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the known texts: len(KNOWN) rows, and those of more (license, text)."""
    rows = spark.createDataFrame(KNOWN, "license string, text string")
    return (rows if more is None else rows.unionByName(more)).select(digest(F.col("text")).alias("digest"), "license").distinct()


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """more: further known texts (license, text). doc_id, text_sha256 (of the canonical text), license (of the entire text, or null), notices (licences of paragraphs or lines, sorted, comma-joined), n_notices (parts that are one)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    # A part can only be a known text if it has a word that every known text has, in some spelling.
    hinted = lambda c: c.rlike("(?i)" + HINT)
    parts = F.when(hinted(F.col("text")), F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n[ \t\x0B\f\r]*\n"), F.array("text"))))
    first = save(rows.select("row", "doc_id", digest(F.col("text")).alias("text_sha256"), F.transform(F.filter(parts, lambda x: hinted(x)), lambda x: digest(x)).alias("parts")), "digests")
    table = known(docs.sparkSession, more)
    table = F.broadcast(table) if more is None else few(table, table.count())  # fixed: len(KNOWN) rows
    hits = first.where("parts is not null").select("row", "text_sha256", F.explode("parts").alias("digest")).join(table, "digest")
    found = hits.groupBy("row").agg(F.max(F.when(F.col("digest") == F.col("text_sha256"), F.col("license"))).alias("license"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.countDistinct("digest").alias("n_notices"))
    return first.join(found, "row", "left").select("doc_id", "text_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def sql() -> str:
    """The same in DuckDB's SQL, with the known texts as values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        t = rf"regexp_replace(lower({x}), '(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
        t = rf"regexp_replace({t}, '[ \t\n\x0B\f\r]+', ' ', 'g')"
        for a, b in SPELLINGS:
            t = f"replace({t}, {quote(a)}, {quote(b)})"
        return rf"trim(regexp_replace({t}, '[ !-/:-@\[-`{{-~]+', ' ', 'g'))"

    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    return rf"""
WITH k AS (
  SELECT DISTINCT license, sha256({canon("t")}) AS digest FROM (VALUES {values}) AS v(license, t)
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), p AS (
  SELECT DISTINCT r, sha256({canon("x")}) AS digest FROM (
    SELECT r, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n[ \t\x0B\f\r]*\n'), [t])) AS x FROM d WHERE regexp_matches(t, '(?i){HINT}'))
  WHERE regexp_matches(x, '(?i){HINT}')
), w AS (
  SELECT r, doc_id, sha256({canon("t")}) AS text_sha256 FROM d
), h AS (
  SELECT r, max(CASE WHEN digest = text_sha256 THEN license END) AS license, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices, count(DISTINCT digest) AS n
  FROM p JOIN k USING (digest) JOIN w USING (r) GROUP BY r
)
SELECT doc_id, text_sha256, license, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notices FROM w LEFT JOIN h USING (r)
"""
