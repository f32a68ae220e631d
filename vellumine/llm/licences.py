"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines gone, equivalent spellings made
one, punctuation and white space reduced to single spaces. The SHA-256 of the whole form is
looked up among the digests of known licences by a hash join.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A part of words, and words, that licence texts vary in, with the spelling that stands for both.
STEM = ("licenc", "licens")
SPELLINGS = [
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("https", "http"),
    ("version", "v"),
]

# Licence notices and texts by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
KNOWN = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT, "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "ISC": [_ISC, "ISC License\n\n" + _ISC, "SPDX-License-Identifier: ISC"],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL, "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "SPDX-License-Identifier: BSD-3-Clause"],
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB, "SPDX-License-Identifier: Zlib"],
    "Unlicense": [_UNLICENSE, "SPDX-License-Identifier: Unlicense"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE_NOTICE, "SPDX-License-Identifier: Apache-2.0"],
    "MPL-2.0": [_MPL_NOTICE, "SPDX-License-Identifier: MPL-2.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-3.0-or-later": [_GPL_NOTICE, "SPDX-License-Identifier: GPL-3.0-or-later"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
}

#: Known digests, of about 100 bytes each, that are broadcast.
BROADCAST_ROWS = 1 << 17

# Lines that name a copyright, and what is no word, in Java and RE2 syntax alike. A line of a licence's own
# text that happens to begin with such a word is none: a year, a sign or a placeholder has to follow, or nothing.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9(\n]*(copyright[ \t:]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*[0-9]|©|all rights reserved[^a-z0-9\n]*$)[^\n]*$"
NO_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a licence text; null stays null."""
    lower = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    # every word has a space of its own on either side, so that replacing one leaves its neighbour's
    form = F.concat(F.lit(" "), F.regexp_replace(lower, NO_WORD, "  "), F.lit(" "))
    form = F.replace(form, *map(F.lit, STEM))
    for spelled, spelling in SPELLINGS:
        form = F.replace(form, F.lit(f" {spelled.replace(' ', '  ')} "), F.lit(f" {spelling.replace(' ', '  ')} "))
    return F.trim(form)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def whole_digests() -> list[tuple[str, str]]:
    """(license, digest) of whole licences that are too long to stand here: common ones as distributions ship them, with and without their appendices."""
    lines = files("vellumine.llm").joinpath("licences.tsv").read_text().splitlines()
    return [tuple(line.split("\t")) for line in lines if line and not line.startswith("#")]


def known_digests(spark: SparkSession, known: dict[str, list[str]] = KNOWN, whole: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of known texts and of known digests (None: those that come along); a digest that two licences share goes to the first by name."""
    table = spark.createDataFrame([(name, text) for name, texts in known.items() for text in texts], "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    table = table.union(spark.createDataFrame(whole_digests() if whole is None else whole, "license string, digest string"))
    return table.groupBy("digest").agg(F.min("license").alias("license"))


def _looked_up(named: DataFrame, digests: DataFrame) -> DataFrame:
    """``named`` with the license of its ``digest``. Known digests are counted first: up to BROADCAST_ROWS of them are broadcast, more are joined by a shuffle."""
    few = digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return named.join(F.broadcast(digests) if few else digests, "digest", "left")


def with_license(df: DataFrame, digests: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``digest`` and ``license``: the known licence that the whole text is, else null.

    A null text has neither. Texts that are nothing but copyright lines, punctuation or space have
    the digest of an empty form, which no licence has. Rows that repeat are each looked up. Columns of these names are replaced.
    """
    # never null, so that the join needs no test that would compute digests twice
    named = df.drop("digest", "license").withColumn("digest", F.coalesce(digest(F.col(text)), F.lit("")))
    joined = _looked_up(named, digests)
    return joined.select(*[c for c in named.columns if c != "digest"], F.nullif("digest", F.lit("")).alias("digest"), "license")


def scanned(df: DataFrame, digests: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest, document_license, n_license_lines, line_licenses): each row's whole text, and each whole line of it, looked up.

    One scan, one join and one count by row: a row's lines meet within its task. n_license_lines counts
    the lines that are a known text, line_licenses names their licences in order, joined by commas (of nothing if there are
    none). Null texts have no digest and no lines. Rows that repeat a key, null ones too, are each judged
    by their own text; other columns are ignored.
    """
    texts = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.col("_text").alias("text"))), F.coalesce(F.transform(F.split("_text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), F.array()))
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = numbered.select("_row", "_key", F.explode(texts).alias("t")).where((F.col("t.line") == 0) | (F.trim("t.text") != ""))
    named = rows.select("_row", "_key", "t.line", F.coalesce(digest(F.col("t.text")), F.lit("")).alias("digest"))
    found = _looked_up(named, digests).where((F.col("line") == 0) | F.col("license").isNotNull())
    whole, line = F.col("line") == 0, F.col("line") > 0
    met = found.groupBy("_row", "_key").agg(
        F.max(F.when(whole, F.nullif("digest", F.lit("")))).alias("digest"),
        F.max(F.when(whole, F.col("license"))).alias("document_license"),
        F.count(F.when(line, 1)).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("line_licenses"),
    )
    return met.select(F.col("_key").alias(key), "digest", "document_license", "n_license_lines", "line_licenses")
