"""License scans by canonical digest lookup. DataFrame functions only.

A text is normalised (case, punctuation, copyright lines, equivalent spellings), digested as a whole, and hash-joined to
the digests of known licence texts. So are its lines, each as a text of its own: a notice such as "Released under the MIT
License." is a known text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textatlas.llm.common import NOT_BLANK

#: Spellings that count as the same word, after case and punctuation are gone.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "organisation": "organization",
    "organisations": "organizations",
    "recognised": "recognized",
    "authorised": "authorized",
    "favour": "favor",
    "fulfil": "fulfill",
    "merchantibility": "merchantability",
    "percent": "per cent",
    "cancelled": "canceled",
    "artefact": "artifact",
    "version": "v",
    "gpl": "gnu general public license",
}

#: Short notices, by SPDX identifier.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}

#: Whole licence texts, by SPDX identifier.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to https://unlicense.org""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

#: Further whole texts of a licence: the headers that files carry.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

_BSD_3_CLAUSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

"""
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", _BSD_3_CLAUSE + "THIS SOFTWARE IS PROVIDED", 1)

#: Headings that may stand over a licence's text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License"],
}

#: What a line has to hold if it is one of the texts above, in any of their spellings.
NOTICE_WORDS = r"(?i)licen[cs]e|SPDX|GPL|software"

# A line that names a holder or reserves rights. Where a body's lines are wrapped, one may start with "copyright" as well: those
# of BODY_LINE stay, as they get a sign before the word.
BODY_LINE = r"\n([ \t#*/;-]*)(copyright (?:holder|owner|notice|law|interest|license|and|or)s?\b)"
COPYRIGHT_LINE = r"(?:copyright\b|\(c\) |©|all rights reserved)[^\n]*"
# What may stand before a line's first word: blanks, comment marks, and the mark of a list's item.
LINE_START = r"\n[ \t#*/;-]*"
ITEM = r"(?:[0-9]{1,2}|[a-z])[.)][ \t]+"


def normalised(text: Column) -> Column:
    """Words of the text in canonical spelling, one blank between; what isn't a-z, 0-9 or non-ASCII separates words.

    Lines that start as a copyright notice, and the numbers or letters of a list's items, are left out; "v2" and "version 2"
    are alike. Null stays null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz ")
    low = F.regexp_replace(F.concat(F.lit("\n"), low), BODY_LINE, "\n$1=$2")
    low = F.regexp_replace(low, LINE_START + COPYRIGHT_LINE, "\n")
    low = F.regexp_replace(low, LINE_START + ITEM, "\n")
    low = F.concat(F.lit(" "), F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "), F.lit(" "))
    for a, b in SPELLINGS.items():
        low = F.replace(low, F.lit(f" {a} "), F.lit(f" {b} "))
    low = F.regexp_replace(low, " v([0-9])", " v  $1")
    return F.trim(F.regexp_replace(low, " +", " "))


def digest(text: Column) -> Column:
    """MD5 of the normalised text; null where nothing is left of it."""
    return F.md5(F.nullif(normalised(text), F.lit("")))


def known_texts(extra: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(license_id, text): the texts above, with and without each of their titles, and those of extra."""
    rows = [(k, t) for table in (NOTICES, extra or {}) for k, ts in table.items() for t in ts]
    bodies = [*TEXTS.items(), *HEADERS.items()]
    return rows + bodies + [(k, f"{title}\n\n{t}") for k, t in bodies for title in TITLES.get(k, [])]


def known_licenses(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """license_id, digest: distinct digests of known_texts(); a digest has one licence, the first by name."""
    known = spark.createDataFrame(known_texts(extra), "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    return known.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _lines(text: Column, own: bool) -> Column:
    """Digests of the lines that can be known: each with a word, or with one of NOTICE_WORDS, without which none is."""
    holds = NOTICE_WORDS if own else NOT_BLANK
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(holds)), lambda x: digest(x))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, most_in_set: int = 10_000) -> DataFrame:
    """doc_id, text_digest, license_id, notices, n_notices: a row per document of docs(doc_id, text).

    text_digest: of the entire text, null for null texts and texts without words. license_id: the known licence with that
    digest, else null. notices: distinct licences whose text is a line of the text, of any length, sorted; n_notices: such
    lines. Repeated rows each get their row; other columns are ignored; an empty table gives no rows.

    known(digest, license_id), distinct by digest; the texts above if None. Up to most_in_set digests (40 bytes each) go to
    the executors as a set; more are joined, with the lines of every distinct text."""
    own = known is None
    known = known_licenses(docs.sparkSession) if own else known.select("digest", "license_id")
    few = known.limit(most_in_set + 1).count() <= most_in_set
    whole = known.select(F.col("digest").alias("text_digest"), "license_id")
    out = docs.select("doc_id", "text", digest(F.col("text")).alias("text_digest")).join(F.broadcast(whole) if few else whole, "text_digest", "left")
    none = F.array().cast("array<string>")
    if few:
        table = [tuple(r) for r in known.select("digest", "license_id").collect()]
        names = F.create_map(*[F.lit(x) for r in table for x in r]) if table else F.create_map().cast("map<string,string>")
        hit = F.filter(_lines(F.col("text"), own), lambda d: d.isin([r[0] for r in table]) if table else F.lit(False))
        out = out.withColumn("found", F.transform(F.coalesce(hit, none), lambda d: F.try_element_at(names, d)))
    else:
        text = docs.where(F.col("text").isNotNull()).select("text").distinct()
        lines = text.select(F.md5("text").alias("__text"), F.explode(_lines(F.col("text"), own)).alias("digest"))
        found = lines.join(known, "digest").groupBy("__text").agg(F.collect_list("license_id").alias("found"))
        out = out.withColumn("__text", F.md5("text")).join(found, "__text", "left").withColumn("found", F.coalesce("found", none))
    return out.select(
        "doc_id", "text_digest", "license_id", F.array_sort(F.array_distinct("found")).alias("notices"), F.size("found").cast("long").alias("n_notices")
    )
