"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is canonicalised line by line: lower case, copyright lines dropped,
everything but letters and digits to one space, equivalent spellings unified.
The md5 of the joined lines is hash-joined to the digests of known licences,
which go through the same expression.  Notices of one line are looked up in the
same way, line by line.  The known table is a constant of this module, so its
broadcast has a fixed size.  No shuffle: each document is decided on its own row.

Known as whole texts: MIT, BSD-2-Clause, BSD-3-Clause, ISC, Unlicense, Apache-2.0,
GPL-1.0, 2.0 and 3.0, LGPL-2.0, 2.1 and 3.0, MPL-1.1 and 2.0, GFDL-1.2 and 1.3, CC0-1.0
and Artistic-1.0-Perl; as notices of one line some of these and CC-BY licences.

Defined results: a null text has a null digest and no licence; an empty one has
the digest of the empty string and no licence; repeated rows stay; an empty
table gives an empty result; input columns named like a result column are
replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.scratch import keeps_names, others, tables

MADE = {"text_digest", "license_id", "line_licenses", "n_license_lines"}

#: A line is a copyright line if it opens with the sign or word and
#: carries a year or a year's placeholder, or only reserves all rights.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}(©]*(copyright|\(c\)|©).*((19|20)[0-9]{2}|<year>|\[year\]|\[yyyy\])|^[^\p{L}]*all rights reserved[^\p{L}]*$"
#: Spellings that count as equal, after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("behaviour", "behavior"), ("whilst", "while"), ("per cent", "percent"), ("and or", "andor"),
)

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Licence texts and standard notices as published.
KNOWN = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", _BSD_OPEN + _BSD_1_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_OPEN + _BSD_1_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_OPEN + _BSD_1_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
)
#: Digests (see ``digest``) of published licence texts that are too long to
#: stand here: the whole text, then without the appendix on how to apply it, with and
#: without the line that ends the terms.
DIGESTS = (
    ("Apache-2.0", ("8fe86a2a939a0cf351d7adfbd877e1c9", "9ccdd331a437062d73673e6771a54eff", "77482471c0629e92b7250897ce04517d")),
    ("Artistic-1.0-Perl", ("a8b0fb0c6e43a3b36bdc159e59dbfd1e",)),
    ("BSD-3-Clause", ("04b285564d79ee6ef72bf5b0c8520d5c",)),
    ("CC0-1.0", ("4183585e3b0187bf0ae6543bf501714e",)),
    ("GFDL-1.2", ("5fbb0bfee76ec85d90d1865cff71a361", "564140b73d9f26ab64fa96475d598b22")),
    ("GFDL-1.3", ("dae17bbfd79f0166b222239d1587bcc4", "0d3ce17b7f7db52f8c4dacd3d9a44ce5")),
    ("GPL-1.0", ("bcfedb8ebf70ecce38dfe0c9cf105ada", "f8ac0f538ef5a507d496390f6ad91912", "5d61d192fd1ff65cdde43ef910492bad")),
    ("GPL-2.0", ("9dbd02643f535c8d53cca5723b3fd837", "a9a2c36b649aa226b9552338ed631ab2", "d63667e47c4ddffba625804204425e4c")),
    ("GPL-3.0", ("dd1723c9fe06be024ffd0ea65b8698b2", "8f122b177788a189ce93839098445880", "d46591fe288dd361bb7a1a65d7d013e7")),
    ("LGPL-2.0", ("86f703a55175f57afe490b4c4adf6510", "5e304ba8136046edf510fa0520b4b557", "4db2bf51d42080f073a151226eb698f1")),
    ("LGPL-2.1", ("073f88ed155107662850ff3581cd4f53", "cc82c33e201e9c0f0c7dbc96b5783b52", "20464f64c97d672e83c30d36ada27fea")),
    ("LGPL-3.0", ("596e05bba16756c985a83f622b1cfd7a",)),
    ("MPL-1.1", ("57bb867dbf1334c39f7d2ae3875834ae", "b69bbb8c0cd672ad0ba5e1d9b7ea38d8")),
    ("MPL-2.0", ("7d4b8b0889da3c01eff3fe431102e6d6", "310bebfffc41fb4428c07a91abbe6c86")),
)


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text; copyright and blank lines are dropped."""

    def canon(line: Column) -> Column:
        out = F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))
        return unified(out)

    kept = F.filter(F.split(F.lower(text), "\r\n|\r|\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    return F.filter(F.transform(kept, canon), lambda x: x != "")


def unified(line: Column) -> Column:
    for a, b in SPELLINGS:
        line = F.replace(line, F.lit(a), F.lit(b))
    return line


def digest(lines: Column) -> Column:
    # Joined once more with the spellings, which may straddle two lines.
    return F.md5(unified(F.array_join(lines, " ")))


def known(spark: SparkSession) -> DataFrame:
    """digest, license_id, one_line: one row per known text; made inside the JVM."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("t")) for i, t in KNOWN]))
    texts = (spark.range(1).select(rows.alias("k"))
             .select(digest(canonical_lines(F.col("k.t"))).alias("__digest"), F.col("k.license_id").alias("license_id"), (~F.col("k.t").contains("\n")).alias("one_line")))
    longer = F.explode(F.array(*[F.struct(F.lit(d).alias("__digest"), F.lit(i).alias("license_id"), F.lit(False).alias("one_line")) for i, ds in DIGESTS for d in ds]))
    return (texts.union(spark.range(1).select(longer.alias("k")).select("k.*"))
            .groupBy("__digest").agg(F.min("license_id").alias("license_id"), F.bool_or("one_line").alias("one_line")))


@keeps_names
def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with text_digest, license_id (whole text), line_licenses, n_license_lines."""
    keep = others(docs, MADE)
    table = known(docs.sparkSession)
    # A constant table, so its digests can be literals.
    one_line = F.create_map(*[F.lit(x) for r in table.filter("one_line").collect() for x in (r["__digest"], r["license_id"])])
    # A generator of one row keeps the optimizer from working out its input anew
    # for each use.
    lines = docs.select(*keep, F.explode(F.array(canonical_lines(F.col("text")))).alias("__lines"))
    hits = F.filter(F.transform("__lines", lambda x: F.element_at(one_line, F.md5(x))), lambda x: x.isNotNull())
    hits = F.coalesce(hits, F.array().cast("array<string>"))
    hashed = lines.select(*keep, digest(F.col("__lines")).alias("text_digest"), F.explode(F.array(hits)).alias("__hits"))
    return (hashed.join(F.broadcast(table.drop("one_line")), F.col("text_digest") == F.col("__digest"), "left")
            .select(*keep, "text_digest", "license_id",
                    F.array_join(F.array_sort(F.array_distinct("__hits")), ",").alias("line_licenses"),
                    F.size("__hits").cast("bigint").alias("n_license_lines")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tables(spark, sf_dir, "documents").select("doc_id", "text"))\
        .select("doc_id", "text_digest", "license_id", "line_licenses", "n_license_lines")


def scan_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the same rows."""

    def spelled(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    def lines(x: str) -> str:
        kept = f"list_filter(regexp_split_to_array(lower({x}), '\\r\\n|\\r|\\n'), lambda l: NOT regexp_matches(l, '{COPYRIGHT_LINE}'))"
        canon = spelled(r"trim(regexp_replace(l, '[^\p{L}\p{N}]+', ' ', 'g'))")
        return f"list_filter(list_transform({kept}, lambda l: {canon}), lambda l: l <> '')"

    whole = f"md5({spelled("array_to_string(ls, ' ')")})"
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    digests = ", ".join(f"('{d}', '{i}')" for i, ds in DIGESTS for d in ds)
    return f"""
    WITH known_lines AS (SELECT id, t, {lines('t')} AS ls FROM (VALUES {values}) v(id, t)),
    known AS (SELECT d, min(id) AS id FROM (SELECT {whole} AS d, id FROM known_lines UNION ALL SELECT * FROM (VALUES {digests}) w(d, id)) GROUP BY 1),
    one_line AS (SELECT {whole} AS d, min(id) AS id FROM known_lines WHERE NOT contains(t, chr(10)) GROUP BY 1),
    canon AS (SELECT row_number() OVER () AS rid, doc_id, {lines('text')} AS ls FROM {docs}),
    hits AS (SELECT rid, string_agg(DISTINCT o.id, ',' ORDER BY o.id) AS ids, count(*) AS n
             FROM (SELECT rid, md5(unnest(ls)) AS d FROM canon) u JOIN one_line o USING (d) GROUP BY rid)
    SELECT doc_id, {whole} AS text_digest, known.id AS license_id,
           coalesce(hits.ids, '') AS line_licenses, coalesce(hits.n, 0) AS n_license_lines
    FROM canon LEFT JOIN known ON known.d = {whole} LEFT JOIN hits USING (rid)"""
