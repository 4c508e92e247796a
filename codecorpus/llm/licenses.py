"""Operator 9: license scan by MinHash bands over text windows.

Only DataFrame functions run on the main path. Templates and documents are
sequences of lower-case ASCII words, seen as shingles of 3 words. Documents
are cut into windows of 8 words every 4 words; a window's MinHash values (one
per band) retrieve the templates that have a window with the same value.
Templates are windowed at every word, so an unchanged stretch of 8 words meets
its own copy and always collides; a window at similarity 0.3 to a template's
is missed by all 24 bands with probability 2e-4, at 0.5 with 6e-8. Retrieved
templates are verified exactly: the share of the template's shingles found in
the window's surroundings (a template's length to either side).

A document without any shingle of any template cannot match and leaves before
the windows are made; this test is exact. The templates are a fixed list, so
their band table is small whatever the corpus, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import let
from ..operators.select import select_where
from .common import Scratch, columns
from .quality_rules import joined

WINDOW, STEP, SHINGLE, BANDS = 8, 4, 3, 24
CONTAINMENT = 0.8

# Clauses that public licenses share.
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
              "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
              "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
              "conditions: The above copyright notice and this permission notice shall be included in all copies or "
              "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
              "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
              "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
              "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
              "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_TWO = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
            "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
            "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
            "with the distribution. ")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")
_BSD_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                 "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
                 "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
                 "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
                 "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
                 "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
                 "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
                 "DAMAGE.")

# Public license notices and whole texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the "
                           "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                           "either express or implied.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                      "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                      "the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-full": _MIT_GRANT,
    "BSD-2-Clause-full": _BSD_TWO + _BSD_WARRANTY,
    "BSD-3-Clause-full": _BSD_TWO + _BSD_THIRD + _BSD_WARRANTY,
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
                "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
                "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
                "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
                "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
                "PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                 "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
                 "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
                 "public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
                 "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
                 "present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
            "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
            "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
            "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
            "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
            "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
            "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
            "distribution.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                       "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                       "(at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                       "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                       "(at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingles(text: Column) -> Column:
    """Hashes of the 3-word shingles in order; none for fewer words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(joined(h, 1), lambda pairs: joined(pairs, 1)))  # each evaluated once


def _bands(window: Column) -> Column:
    """One key per band: the band's MinHash value of the window's shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda k: F.xxhash64(k, F.array_min(F.transform(window, lambda x: F.xxhash64(x, k)))))


def _windows(sh: Column, step: int) -> Column:
    """(start, shingles) of the windows that begin every ``step`` words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(sh) - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct(s.alias("at"),
                                                 F.slice(sh, s + 1, F.lit(WINDOW - SHINGLE + 1)).alias("w")))
    return F.filter(cut, lambda x: F.size(x.w) > 0)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, tsh, words) with the distinct shingles of each template."""
    pairs = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("t")) for k, v in templates.items()])
    rows = spark.range(1).select(F.inline(pairs)).withColumn("sh", shingles(F.col("t")))
    return rows.select("license", "sh", F.array_distinct("sh").alias("tsh"),
                       (F.size("sh") + SHINGLE - 1).alias("words"))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
         text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and template found in it: doc_id, license,
    containment (best share of the template's distinct shingles).

    Null and empty texts and texts without a match give no rows; a repeated
    row gives its own rows; an empty table gives no rows."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "licenses")
    forms = template_table(spark, templates or TEMPLATES)
    known = sorted({h for r in forms.select("tsh").collect() for h in r["tsh"]})  # the fixed list's shingles
    vocabulary = F.split(F.lit(",".join(map(str, known))), ",").cast("array<bigint>")
    docs = select_where(columns(documents, doc_id=id_col, text=text_col), ["doc_id"], {"sh": shingles(F.col("text"))},
                        lambda r: F.arrays_overlap(r["sh"], vocabulary))
    near = scratch.save(docs.withColumn("row", F.monotonically_increasing_id()), "near")
    wanted = (forms.select("license", F.explode(_windows(F.col("sh"), 1)).alias("x"))
              .select("license", F.explode(_bands(F.col("x.w"))).alias("band")).distinct())
    seen = (near.select("row", F.explode(_windows(F.col("sh"), STEP)).alias("x"))
            .select("row", F.col("x.at").alias("at"), F.explode(_bands(F.col("x.w"))).alias("band")))
    found = scratch.save(seen.join(F.broadcast(wanted), "band").select("row", "at", "license").distinct(), "found")
    left = F.greatest(F.col("at") - F.col("words"), F.lit(0))
    right = F.col("at") + WINDOW + F.col("words") - SHINGLE  # last shingle inside the surroundings
    # rows with any shingle of a template grow with the corpus: never broadcast
    best = (found.join(near.hint("merge"), "row").join(F.broadcast(forms.drop("sh")), "license")
            .select("row", "doc_id", "license",
                    (F.size(F.array_intersect(F.slice("sh", left + 1, right - left + 1), "tsh")) / F.size("tsh"))
                    .alias("c"))
            .groupBy("row", "doc_id", "license").agg(F.max("c").alias("containment")))
    return best.where(F.col("containment") >= containment).select("doc_id", "license", "containment")


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """The same rows by looking at every window and template."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (templates or TEMPLATES).items())
    return rf"""
WITH forms AS (
  SELECT license, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM (VALUES {values}) AS v(license, t)),
marks AS (
  SELECT license, len(ws) AS words, list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) AS sh
  FROM forms),
wanted AS (SELECT license, words, len(sh) AS total, unnest(sh) AS s FROM marks),
texts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
items AS (
  SELECT doc_id, len(ws) - 2 AS n, unnest(range(0, len(ws) - 2)) AS pos,
    unnest([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) AS s FROM texts WHERE len(ws) >= 3),
hits AS (SELECT doc_id, n, pos, license, words, total, s FROM items JOIN wanted USING (s)),
spread AS (
  SELECT doc_id, license, total, s, unnest(range(
    greatest(0, pos - {WINDOW} - words + {SHINGLE} + {STEP - 1}) // {STEP} * {STEP},
    least(n - 1, pos + words) + 1, {STEP})) AS spot FROM hits)
SELECT doc_id, license, max(c) AS containment FROM (
  SELECT doc_id, license, spot, count(DISTINCT s) / total AS c FROM spread GROUP BY doc_id, license, spot, total)
GROUP BY doc_id, license HAVING max(c) >= {CONTAINMENT}
"""
