"""License scans: MinHash bands over text windows find notices, exact containment verifies them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_or_empty

#: (license, notice): fixed values, the wording of common notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
SHINGLE = 5
CONTAINED = 0.8
#: Shingles of a window (a power of two). Windows start at every shingle, so each shares three of four with the next.
WINDOW = 4
#: Bands of one hash row each.
BANDS = 3


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.flatten(F.transform(F.array(value), use))


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, in order; letters and digits of any script make words, without case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _let(words, _hashed)


def _hashed(words: Column) -> Column:
    n = F.size(words) - SHINGLE + 1
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    )


def bands(hashes: Column) -> Column:
    """The band values of all windows: per band, the least of a window's shingles under that band's own hash.

    The windows at the end are shorter, down to the last shingle alone.
    """

    def minima(band: int) -> Column:
        rows = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))
        width = 1
        while width < WINDOW:
            rows = _let(rows, lambda a, w=width: F.zip_with(a, F.slice(a, w + 1, F.greatest(F.size(a) - w, F.lit(0))), lambda x, y: F.least(x, y)))
            width *= 2
        return F.array_distinct(rows)

    return F.concat(*[minima(band) for band in range(BANDS)])


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"CAST('{v}' AS BIGINT)" for v in values) + ")")


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, template, license, matched, shingles, containment of every verified match of every row.

    ``template`` numbers the notices, which are a parameter and small. Windows of
    ``WINDOW`` shingles start at each shingle of a text and of a notice. Two windows with
    Jaccard similarity J agree in one of the bands with probability 1 - (1 - J) ** BANDS.
    Where a text holds any four shingles of a notice in a row, it has a window equal to one
    of the notice's, J is 1, and the pair is found with certainty wherever it lies; a notice
    with four fifths of its shingles in one place has such a window. One whose shingles are
    torn into pieces of three and less is found with the probability above. Bands only bring
    (row, notice) pairs; containment is then the share of the notice's distinct shingles
    found anywhere in the whole text, and ``contained`` of them make a match.

    Rows are matched each by itself, repeated and null ids included. Texts with fewer words
    than a shingle, null and empty ones match nothing, nor do notices of fewer words.
    Other columns are not read. All work on a row stays in its task: nothing is shuffled.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string")
    known = given.select("template", "license", shingles(F.col("text")).alias("s")).where("size(s) > 0")
    known = known.select("template", "license", F.array_distinct("s").alias("s"), bands(F.col("s")).alias("b")).orderBy("template").collect()
    if not known:
        return docs.select(F.col("doc_id").cast("long")).limit(0).selectExpr(
            "doc_id", "0 AS template", "'' AS license", "0L AS matched", "0L AS shingles", "0D AS containment"
        )

    rows = docs.select(F.col("doc_id").cast("long"), shingles(text_or_empty()).alias("s"))
    rows = rows.select("doc_id", "s", bands(F.col("s")).alias("b"))
    rows = rows.where(F.arrays_overlap("b", _longs(sorted({v for k in known for v in k["b"]}))))
    pairs = [
        F.when(
            F.arrays_overlap("b", _longs(k["b"])),
            F.struct(
                F.lit(k["template"]).alias("template"),
                F.lit(k["license"]).alias("license"),
                F.size(F.array_intersect("s", _longs(k["s"]))).cast("long").alias("matched"),
                F.lit(len(k["s"])).cast("long").alias("shingles"),
            ),
        )
        for k in known
    ]
    found = rows.select("doc_id", F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("p")).select("doc_id", "p.*")
    return found.withColumn("containment", F.col("matched") / F.col("shingles")).where(F.col("containment") >= contained)
