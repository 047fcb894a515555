"""Licence scans by canonical digest lookup.

A text is put into canonical form (ASCII lower case, copyright lines dropped,
equivalent spellings unified, everything but letters and digits turned into
single spaces), digested with SHA-256, and the digest of the entire text is
hash-joined to those of known licence texts. The same is done with every line
as an entire text, which finds one-line licence notices in longer documents.

Everything is DataFrame functions; the table of known texts is put into
canonical form by the same expressions. Defined cases: a null text or one
that is empty in canonical form has a null digest and no licence; repeated
rows are each reported; a text under several ids reports each, sorted and
comma-joined; an empty table gives no rows; extra columns are ignored by
:func:`scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence notices and short licence texts, by SPDX id.
KNOWN = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Released under CC0 1.0."],
    "ISC": [
        'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL-3.0-or-later": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "Unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    ],
    "Zlib": [
        "zlib License This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
}

#: Pairs of spellings held equal, in the order they are applied (to lower-case text).
SPELLINGS = [("https://", "http://"), ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("favour", "favor"), ("&", "and")]

#: A line that starts as a copyright statement. Lines end at line feeds alone.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[^a-z\n]|\(c\)|©)[^\n]*$"
#: SHA-256 of nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _lower(text: Column) -> Column:
    """Lower case, as far as letters a to z go: the two characters beyond A-Z whose lower case has one are taken out."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00d7")), F.lit("\u0130"), F.lit("\u00d7")))


def by_lines(text: Column) -> Column:
    """The canonical form of a text and of each of its lines at once: words and line feeds with single spaces between
    them. No step reaches across a line feed. (Words are extracted: replacing what is no word takes five times as long.)"""
    out = F.regexp_replace(_lower(text), COPYRIGHT_LINE.replace("(?m)", "(?md)"), "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.array_join(F.regexp_extract_all(out, F.lit(r"[a-z0-9]+|\n"), 0), " ")


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return F.trim(F.regexp_replace(by_lines(text), "[ \n]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form in hex; null where nothing is left."""
    return F.nullif(F.sha2(canonical(text), 256), F.lit(EMPTY))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the fixed texts above, a few dozen rows."""
    rows = [(k, t) for k, texts in KNOWN.items() for t in texts]
    return spark.createDataFrame(rows, "license_id string, body string").select(digest(F.col("body")).alias("digest"), "license_id")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, notices, n_notice_lines) of every row.

    license_id: of the known licence that the entire text is. notices: those
    of the known licences that single lines are, sorted and comma-joined.
    Rows with equal doc_id and text are looked up once and reported each.

    Every text is put into canonical form once. The entire text (place -1) and
    its lines become rows, of which only the digests go on, and of the lines
    only those that a licence is found for.
    """
    ids = known_digests(docs.sparkSession) if known is None else known
    ids = ids.where("digest is not null").groupBy(F.col("digest").alias("known")).agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    # the table above is a few dozen fixed texts; one handed in is joined as its size allows
    ids = F.broadcast(ids) if known is None else ids
    forms = docs.select("doc_id", F.xxhash64("text").alias("at"), by_lines(F.col("text").cast("string")).alias("form"))
    whole = F.sha2(F.trim(F.regexp_replace(F.replace("form", F.lit("\n"), F.lit(" ")), " {2,}", " ")), 256)
    parts = forms.select("doc_id", "at", whole.alias("whole"), F.split("form", "\n", -1).alias("lines"))
    rows = parts.select("doc_id", "at", "whole", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("lines", F.array().cast("array<string>")))).alias("place", "line"))
    told = rows.select("doc_id", "at", "whole", "place", F.when(F.col("place") == 0, F.col("whole")).otherwise(F.sha2(F.trim("line"), 256)).alias("own"))
    own = told.join(ids, F.col("own") == F.col("known"), "left").where("place = 0 or ids is not null")
    line = F.col("place") > 0
    grouped = own.groupBy("doc_id", "at", "whole").agg(
        F.count_if(~line).alias("copies"), F.max(F.when(~line, F.array_join("ids", ","))).alias("license_id"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(line, F.col("ids")))))), ",").alias("notices"),
        F.size(F.collect_set(F.when(line, F.col("place")))).cast("long").alias("n_notice_lines"),
    )
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", F.nullif("whole", F.lit(EMPTY)).alias("digest"), "license_id", "notices", "n_notice_lines")


def oracle_sql() -> str:
    """DuckDB SQL for :func:`scan` over the view documents."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"regexp_replace(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{COPYRIGHT_LINE}', '', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, {q(a)}, {q(b)})"
        return f"nullif(trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')), '')"

    rows = ", ".join(f"({q(k)}, {q(t)})" for k, texts in KNOWN.items() for t in texts)
    return f"""
    WITH known AS (SELECT sha256({form("body")}) AS digest, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_id
                   FROM (VALUES {rows}) AS v(license_id, body) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    noted AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n
              FROM lines JOIN known ON sha256({form("line")}) = digest GROUP BY 1)
    SELECT d.doc_id, sha256({form("d.text")}) AS digest, k.license_id, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notice_lines
    FROM documents d LEFT JOIN known k ON sha256({form("d.text")}) = k.digest LEFT JOIN noted USING (doc_id)
    """
