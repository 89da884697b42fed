"""Operator 9: license notices, found by MinHash bands over overlapping text windows, in DataFrame operations only.

Templates fall into classes by length. A text is cut into windows of twice the class's longest template, each one such length
behind the last, so wherever a notice stands, some window holds it whole. A window without a single shingle of the templates
matches none and is passed over (this loses nothing). Each other window, and each template, has one minimum per band, all by one aggregate; those
that agree in a band are candidates. The number of bands follows from the lowest similarity that a match can have, so that one is missed with
probability ``MISS`` at most. A candidate counts if ``CONTAINED`` of the template's shingles, compared as words, are in the window.

Templates are few and their shingles are broadcast: more than ``BOUND`` shingles are refused.

Words are runs of a-z and 0-9, A-Z lower-cased; shingles have five words. Defined results: a document without a match gives no row; null
and empty texts have no words; a document with several notices gives a row for each template; every row is scanned by itself, and rows that share an id, or
a null id, give one row a template, of their best window; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import stored, table

SHINGLE, CONTAINED, MISS, BOUND = 5, 0.8, 1e-9, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Notices as their licenses word them, of five words or more.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_shingles(words: list[str], size: int) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


def classes(templates: dict[str, str], size: int) -> list[tuple[int, dict[str, list[str]]]]:
    """(longest, shingles by template) for lengths up to 8, 16, 32 words and so on."""
    found: dict[int, dict[str, list[str]]] = {}
    for name, text in sorted(templates.items()):
        found.setdefault(max(8, 1 << (len(template_words(text)) - 1).bit_length()), {})[name] = template_words(text)
    return [(max(map(len, t.values())), {n: template_shingles(w, size) for n, w in t.items()}) for _, t in sorted(found.items())]


def bands_for(longest: int, shingles: dict[str, list[str]], size: int) -> int:
    """Bands of one minimum each with which a match is missed with probability MISS at most."""
    lowest = min(math.ceil(CONTAINED * len(s)) / (2 * longest - size + 1 + len(s) - math.ceil(CONTAINED * len(s))) for s in shingles.values())
    return math.ceil(math.log(MISS) / math.log(1 - min(lowest, 0.999)))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), "")


def hashed_shingles(hashes: str, size: int) -> Column:
    """A hash for each run of ``size`` words, from the column of the words' hashes; of the whole, if there are fewer.

    The argument is a column's name, so that a lambda reads what was computed once instead of computing it for each element.
    """
    return F.transform(F.slice(hashes, 1, F.greatest(F.lit(1), F.size(hashes) - size + 1)), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, size))))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters cannot pull back in: as an alias it would be computed anew wherever it is read, and within a
    lambda for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def minima(rows: DataFrame, by: list[str], bands: int) -> DataFrame:
    """The least hash of the rows' names for each band: by, band, least. One aggregate, with partial minima before the shuffle."""
    names = rows.select(*by, F.explode("names").alias("name"))
    banded = names.select(*by, "name", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    return banded.groupBy(*by, "band").agg(F.min(F.xxhash64("name", "band")).alias("least"))


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, size: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment (highest of a window), first_word (of the first window that matches), windows (that match)."""
    spark = docs.sparkSession
    parts = classes(templates, size)
    rows = [(k, n, s) for k, (_, shingles) in enumerate(parts) for n, s in shingles.items()]  # as many as there are templates
    if sum(len(s) for *_, s in rows) > BOUND:
        raise ValueError(f"the templates have more than {BOUND} shingles")
    known = spark.createDataFrame(rows, "class int, license string, shingles array<string>")

    def name(s: Column) -> Column:  # as hashed_shingles names it
        w = F.split(s, " ")
        return F.xxhash64(*(F.xxhash64(F.get(w, F.lit(k))) for k in range(size)))

    named = known.withColumn("names", F.transform("shingles", name))
    literal = {r["license"]: r["names"] for r in named.select("license", "names").collect()}  # of the templates alone
    every = F.array(*(F.lit(x) for x in sorted({x for names in literal.values() for x in names})))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words_of(F.col("text").cast("string")))).alias("words"))
    texts = once(texts, "hashes", F.transform("words", lambda w: F.xxhash64(w)))
    texts = once(texts, "names", hashed_shingles("hashes", size)).drop("hashes").where(F.arrays_overlap("names", every))
    # the few that hold a shingle of any template, for all classes; row tells texts of one id apart
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()))
    found = None
    for k, (longest, shingles) in enumerate(parts):
        bands = bands_for(longest, shingles, size)
        own = F.array(*(F.lit(x) for x in sorted({x for n in shingles for x in literal[n]})))
        windows = (
            texts.select("row", "words", "names", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(longest))).alias("start"))
            .select("row", "start", F.slice("words", F.col("start") + 1, F.lit(2 * longest)).alias("words"), F.slice("names", F.col("start") + 1, F.lit(max(1, 2 * longest - size + 1))).alias("names"))
            .where(F.arrays_overlap("names", own))
        )
        banded = minima(named.where(F.col("class") == k), ["license"], bands)
        met = minima(windows, ["row", "start"], bands).join(F.broadcast(banded), ["band", "least"]).select("row", "start", "license").distinct()
        there = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1)), lambda i: F.array_join(F.slice("words", i, size), " "))
        met = met.join(windows.select("row", "start", "words"), ["row", "start"]).join(F.broadcast(named.select("license", "shingles")), "license")
        met = met.withColumn("containment", F.size(F.array_intersect("shingles", there)) / F.size("shingles")).where(F.col("containment") >= contained)
        met = met.select("row", "license", "start", "containment")
        found = met if found is None else found.unionByName(met)
    of = found.join(texts.select("row", "doc_id"), "row")
    return of.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count("*").alias("windows"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same windows and containment in DuckDB SQL, every template held against every window."""
    rows = [f"('{n}', {longest}, {s!r})" for longest, shingles in classes(TEMPLATES, SHINGLE) for n, s in shingles.items()]
    return f"""
with t(license, longest, shingles) as (values {', '.join(rows)}),
d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '') as words from documents),
w as (select doc_id, longest, start, words[start + 1 : start + 2 * longest] as words from (select doc_id, words, longest, unnest(range(0, len(words), longest)) as start from d cross join (select distinct longest from t))),
s as (select doc_id, longest, start, list_transform(range(1, greatest(2, len(words) - {SHINGLE - 2})), lambda i: array_to_string(words[i : i + {SHINGLE - 1}], ' ')) as there from w),
m as (select doc_id, license, start, len(list_intersect(shingles, there)) / len(shingles) as containment from s join t using (longest))
select doc_id, license, max(containment) as containment, min(start) as first_word, count(*) as windows from m where containment >= {CONTAINED} group by doc_id, license
"""
