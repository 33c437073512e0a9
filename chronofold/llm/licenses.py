"""Licence scan: units of text against licence templates by the Dice coefficient of their word bigrams.

Units are a text's lines and its blank-line separated paragraphs. A unit is normalised
(lower case, words of letters and digits), its distinct word bigrams counted, and only
templates whose size allows the wanted coefficient are compared: with Dice >= t, the sizes
a and b satisfy t / (2 - t) <= a / b <= (2 - t) / t. The pruning is an equality join on the
unit's size with a table of the sizes that each template allows. DataFrame functions only.

Only texts that hold enough of some template's bigrams anywhere are looked at more closely;
they are written to the shared folder first. A notice amid other words is in no unit of its
own. These texts are also searched for windows, stretches of words that begin and end in bigrams
of the template; of overlapping windows the likest is taken. A licence that has units in a
text is not counted by windows there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of

# Customary licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
# Paragraphs of customary licence texts.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _HOPE.format("program", "General Public License")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License")),
    ("LGPL-3.0", _HOPE.format("library", "Lesser General Public License")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License")),
    ("AGPL-3.0", _HOPE.format("program", "Affero General Public License")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbouring words; empty for fewer than two words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda k: F.concat_ws(" ", F.get(tokens, k - 1), F.get(tokens, k)))
    return F.when(F.size(tokens) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_table(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(size, licence, template, grams): a row for each size of unit that a template allows."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, licence string, text string")
    grams = rows.withColumn("grams", bigrams(words("text"))).where(F.size("grams") > 0)
    low = F.ceil(F.size("grams") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    high = F.floor(F.size("grams") * ((2 - threshold) / threshold) + 1e-9).cast("int")
    return grams.select(F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("size"), "licence", "template", "grams")


def _pairs(w: str, known: list[str] | None = None) -> Column:
    """Pairs of neighbouring words in their order, or those of them that are ``known``."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.concat_ws(" ", F.get(F.col(w), k - 1), F.get(F.col(w), k)))
    return pairs if known is None else F.filter(pairs, lambda p: p.isin(known))


def _held(df: DataFrame, id_col: str, text_col: str, templates, threshold: float) -> DataFrame:
    """(id, text) of the texts that hold enough of a template's bigrams for a unit or a window to be like it.

    Units and windows are stretches of the text's words. What is like a template shares
    threshold / (2 - threshold) of the template's bigrams at least, and so does its text.
    """
    rows = template_table(df.sparkSession, templates, threshold).select("template", "grams").distinct().collect()
    share = threshold / (2 - threshold)
    need = [math.ceil(len(r.grams) * share - 1e-9) for r in rows]
    plain = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if not rows:
        return plain.where("false")
    every = sorted({g for r in rows for g in r.grams})
    # explode(array(x)) computes x once a row: a filter pushed down would compute it again for every word
    tokens = plain.select("id", "text", F.explode(F.array(words("text"))).alias("w")).where(F.size("w") >= 2)
    known = tokens.select("id", "text", F.explode(F.array(F.array_distinct(_pairs("w", every)))).alias("known")).where(F.size("known") >= min(need))
    wanted = F.array(*[F.struct(F.lit(r.grams).alias("grams"), F.lit(n).alias("need")) for r, n in zip(rows, need)])
    return known.where(F.exists(wanted, lambda t: F.size(F.array_intersect(F.col("known"), t.grams)) >= t.need)).select("id", "text")


def _window_hits(texts: DataFrame, templates, threshold: float) -> DataFrame:
    """(id, licence, dice, n_units) by windows; a window has at most as many bigrams as its template allows."""
    share = threshold / (2 - threshold)  # of a template's bigrams, in any window that is like it
    tokens = texts.select("id", "text", F.explode(F.array(words("text"))).alias("w"))
    grams = tokens.select("id", F.sha2("text", 256).alias("doc"), F.explode(F.array(_pairs("w"))).alias("grams"))
    of = template_table(texts.sparkSession, templates, threshold).groupBy("template", "licence", "grams").agg(F.min("size").alias("low"), F.max("size").alias("high")).withColumnRenamed("grams", "wanted")
    met = grams.crossJoin(F.broadcast(of.withColumn("need", F.ceil(F.size("wanted") * F.lit(share) - F.lit(1e-9)).cast("int"))))
    held = met.where(F.size(F.array_intersect("grams", "wanted")) >= F.col("need"))
    at = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains("wanted", F.get(F.col("grams"), i)))
    places = held.select("id", "doc", "grams", "licence", "wanted", "low", "high", "need", F.explode(F.array(at)).alias("at"))
    # a window holds ``need`` of the places at least and ``high`` at most, so its end is among the next ones
    starts = places.select("*", F.posexplode("at").alias("p", "i")).where(F.get("at", F.col("p") + F.col("need") - 1) - F.col("i") < F.col("high"))
    ends = starts.withColumn("j", F.explode(F.filter(F.slice("at", F.col("p") + F.col("need"), F.greatest(F.col("high") - F.col("need") + 1, F.lit(0))), lambda j: (j - F.col("i") + 1 >= F.col("low")) & (j - F.col("i") + 1 <= F.col("high")))))
    sized = ends.select("id", "doc", "licence", "i", "j", "wanted", F.array_distinct(F.slice("grams", F.col("i") + 1, F.col("j") - F.col("i") + 1)).alias("own"))
    like = sized.withColumn("dice", 2 * F.size(F.array_intersect("own", "wanted")) / (F.size("own") + F.size("wanted"))).where(F.col("dice") >= threshold)
    found = F.sort_array(F.collect_set(F.struct("dice", "licence", "i", "j")), asc=False)
    none = F.array().cast("array<struct<dice:double,licence:string,i:int,j:int>>")
    taken = F.aggregate("found", none, lambda got, x: F.when(F.exists(got, lambda y: (y.i <= x.j) & (x.i <= y.j)), got).otherwise(F.concat(got, F.array(x))))
    chosen = like.groupBy("id", "doc").agg(found.alias("found")).select("id", F.explode(taken).alias("x"))
    return chosen.groupBy("id", "x.licence").agg(F.max("x.dice").alias("dice"), F.count(F.lit(1)).alias("n_units"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, licence, dice, n_units): a row per row's licence, with its best coefficient and the number of matching units.

    Rows without a match give nothing; null and empty texts never match; null ids are
    reported under the null id; rows that share an id are reported together; a unit that is
    equally like two licences counts for the last by name; an empty table gives an empty result.
    """
    texts = cut(_held(df, id_col, text_col, templates, threshold), "licence-texts")
    pieces = F.array_union(F.split("text", "\n"), F.split("text", r"\n\s*\n"))
    units = texts.select("id", F.explode(pieces).alias("unit"))
    # a unit with more distinct bigrams than any template allows can't match; long units are mostly that
    sized = units.withColumn("w", words("unit")).where(F.size("w") >= 2).withColumn("grams", bigrams(F.col("w"))).withColumn("size", F.size("grams")).select("id", "unit", "grams", "size")
    allowed = F.broadcast(template_table(df.sparkSession, templates, threshold).withColumnRenamed("grams", "wanted"))
    met = sized.join(allowed, "size")
    dice = 2 * F.size(F.array_intersect("grams", "wanted")) / (F.col("size") + F.size("wanted"))
    found = met.select("id", "licence", "unit", dice.alias("dice")).where(F.col("dice") >= threshold)
    # a unit counts for the licence that it is most like
    best = found.groupBy("id", "unit").agg(F.max(F.struct("dice", "licence")).alias("best"))
    per_unit = best.select("id", "best.licence", "best.dice")
    whole = per_unit.groupBy("id", "licence").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units"))
    amid = _window_hits(texts, templates, threshold)
    both = whole.withColumn("_whole", F.lit(1)).unionByName(amid.withColumn("_whole", F.lit(0)))
    return both.groupBy("id", "licence").agg(F.max(F.struct("_whole", "dice", "n_units")).alias("best")).select("id", "licence", "best.dice", "best.n_units")


def oracle_sql(table: str = "documents", templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan of whole lines and paragraphs for TEMPLATES in DuckDB SQL; every unit is compared with every template there."""
    quote = lambda s: s.replace("'", "''")
    values = ", ".join(f"('{quote(name)}', '{quote(text)}')" for name, text in templates)
    tokens = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))"
    return f"""
WITH templates AS (SELECT licence, {grams} AS wanted FROM (SELECT licence, {tokens('t')} AS w FROM (VALUES {values}) v(licence, t))),
units AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM {table}
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')) AS unit FROM {table})),
sized AS (SELECT doc_id, unit, {grams} AS grams FROM (SELECT doc_id, unit, {tokens('unit')} AS w FROM units) WHERE len(w) >= 2),
met AS (
  SELECT doc_id, licence, unit, 2.0 * len(list_intersect(grams, wanted)) / (len(grams) + len(wanted)) AS dice
  FROM sized JOIN templates ON list_has_any(grams, wanted))
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(*) AS n_units
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence DESC) AS place FROM met WHERE dice >= {threshold})
WHERE place = 1 GROUP BY doc_id, licence"""
