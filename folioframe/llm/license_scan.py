"""Licence scans: Dice coefficient over word bigrams against licence templates.

Text is normalised (A-Z lowered, every run of other characters than a-z and 0-9 a space) and compared in units: each
line, the whole text, and every stretch of consecutive words, so that a notice that is wrapped over lines or stands
inside a longer line is found too. A unit matches if its Dice coefficient with a template reaches the threshold.

A line or whole text that matches stands as it is: stretches inside it don't count, and others only where they match
better than every matching line they touch. Of stretches that overlap the best stands (then the longer one, then the
first in name). The best stretch begins and ends with bigrams of its template and doesn't repeat its first one, as
leaving those off never lowers the coefficient; so stretches from one place end where its bigram recurs or where they
hold more bigrams than any match may, and time stays within (bigrams of all templates) x (words of the text).

Texts without a bigram that some template's matches must have are dropped before Python reads them. Templates are a
fixed short list.

Cases: a null or empty text, a unit of fewer than two words: no bigrams, no match; ties between templates go to the one
first in name; texts of any length are searched whole; rows that share a doc_id share their matches; a null doc_id
matches with itself; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import small_batches, table

THRESHOLD = 0.8

#: Short notices, the fixed sentences and full texts of well-known licences.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


_LOWER = {i: i + 32 for i in range(65, 91)}
_OTHER = re.compile("[^a-z0-9]+")


def tokens(text: str) -> list[str]:
    return [w for w in _OTHER.split(text.translate(_LOWER)) if w]


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _best(grams: set[str], known: list[tuple[str, frozenset[str]]]) -> tuple[float, str]:
    """(-dice, license) of the template that is nearest."""
    return min(((-2.0 * len(grams & t) / (len(grams) + len(t)), name) for name, t in known), default=(0.0, "")) if grams else (0.0, "")


def matches(text: str, known: list[tuple[str, frozenset[str]]], threshold: float = THRESHOLD) -> list[tuple[str, float, str]]:
    """(license, dice, sorted bigrams) of the units of a text that match a template."""
    words, line_of, out = [], [], []
    lines = [x for x in text.split("\n") if x != text]
    said = [0.0] * len(lines)
    for k, line in enumerate(lines):
        w = tokens(line)
        words += w
        line_of += [k] * len(w)
        d, name = _best(own := set(bigrams(w)), known)
        if -d >= threshold:
            said[k] = -d
            out.append((name, -d, "|".join(sorted(own))))
    if not lines:
        words = tokens(text)
        line_of = [-1] * len(words)
    grams = bigrams(words)
    d, name = _best(own := set(grams), known)
    if -d >= threshold:
        return [*out, (name, -d, "|".join(sorted(own)))]
    taken = bytearray(len(words))
    fits = [(name, t) for name, t in known if len(own & t) >= len(t) * threshold / (2 - threshold) - 1e-9]

    def ahead(i: int):
        """The best stretch from word i on that may stand: (-dice, -words, license, i), or None."""
        best = None
        for name, t in fits:
            if grams[i] not in t:
                continue
            most, seen, both, rival = len(t) * (2 - threshold) / threshold + 1e-9, set(), 0, 0.0
            for j in range(i, len(grams)):
                g = grams[j]
                if taken[j] or taken[j + 1] or (j > i and g == grams[i]):
                    break
                rival = max(rival, said[line_of[j]] if lines else 0.0, said[line_of[j + 1]] if lines else 0.0)
                if g not in seen:
                    seen.add(g)
                    if len(seen) > most:
                        break
                    both += g in t
                dice = 2.0 * both / (len(seen) + len(t))
                if g in t and dice >= threshold and dice > rival and not (lines and line_of[i] == line_of[j + 1] and said[line_of[i]]):
                    best = min(best or (0.0,), (-dice, i - j - 2, name, i))
        return best

    heap = [x for i in range(len(grams)) if (x := ahead(i))] if fits else []
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        now = ahead(top[3])
        if now == top:
            d, n, name, i = top
            taken[i : i - n] = b"\1" * -n
            out.append((name, -d, "|".join(sorted(set(grams[i : i - n - 1])))))
        elif now:
            heapq.heappush(heap, now)
    return out


def key_grams(known: list[tuple[str, list[str]]], low: float) -> list[str]:
    """Bigrams of which every matching unit has one: a match has ``low`` of a template's bigrams at least, and these are
    one more than it may lack. Long bigrams first, as they are rare."""
    return sorted({g for _, grams in known for g in sorted(grams, key=lambda g: (-len(g), g))[: int(len(grams) * (1 - low) + 1e-9) + 1]})


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, license (the best template, or null), dice (rounded to six places), n_units (units
    that match a template)."""
    small_batches(docs.sparkSession)
    known = [(k, frozenset(g)) for k, t in sorted(templates.items()) if (g := bigrams(tokens(t)))]
    keys = "|".join(g.replace(" ", "[^A-Za-z0-9]+") for g in key_grams(known, threshold / (2 - threshold))) or "a^"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(i, *m) for i, text in enumerate(b.column(1).to_pylist()) for m in matches(text, known, threshold)]
            at, name, dice, grams = zip(*hits) if hits else ((), (), (), ())
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(grams, pa.string())], ["_id", "license", "dice", "b"])

    schema = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("b", T.StringType())])
    hits = docs.select("doc_id", "text").where(F.col("text").rlike(rf"(?i)(?<![a-z0-9])(?:{keys})(?![a-z0-9])")).mapInArrow(found, schema)
    best = hits.groupBy("_id").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"), F.count_distinct("b").alias("n_units"))
    out = docs.select("doc_id").join(best, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.col("best.license").alias("license"), F.round(-F.col("best.d"), 6).alias("dice"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = rf"""
WITH tpl(license, t) AS (
  VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}
), u AS (
  SELECT doc_id, unnest(list_append(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> coalesce(text, '')), coalesce(text, ''))) AS unit FROM documents
), uw AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM u
), short AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM uw WHERE len(w) >= 2
), tw AS (
  SELECT license, string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM tpl
), tb AS (
  SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw
), hit AS (
  SELECT s.doc_id, list_sort(s.b) AS b, license, 2.0 * len(list_intersect(s.b, tb.b)) / (len(s.b) + len(tb.b)) AS dice
  FROM short s JOIN tb ON len(s.b) * 1.5 + 1 >= len(tb.b) AND len(s.b) <= len(tb.b) * 1.5 + 1
), best AS (
  SELECT doc_id, arg_min(license, {{'d': -dice, 'l': license}}) AS license, max(dice) AS dice, count(DISTINCT b) AS n_units FROM hit WHERE dice >= 0.8 GROUP BY doc_id
)
SELECT d.doc_id, best.license, round(best.dice, 6) AS dice, coalesce(best.n_units, 0) AS n_units
FROM documents d LEFT JOIN best USING (doc_id)
"""
