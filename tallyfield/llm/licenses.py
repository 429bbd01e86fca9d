"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is looked at in units: every line, every block of several lines between blank lines, and the whole text if it has
several blocks. A unit is normalised (A-Z in lower case, everything but letters and digits a space) and becomes the set
of its word bigrams, hashed. The Dice coefficient of two sets can reach the threshold t only if their sizes differ by
at most a factor of (2 - t) / t, so a template is compared with a unit only if the unit's size lies in those bounds.
The best template of a unit at or above the threshold is reported; of equals the one listed first.

The templates are literals of the plan. Each text is worked on alone, with DataFrame functions only, without a shuffle.

Defined results: null and empty texts and units of fewer than two words report nothing; repeated rows report alike; a
null ``doc_id`` is kept. An empty table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import lower_ascii, pinned, query, table, text_or_empty

#: Least Dice coefficient of a report.
THRESHOLD = 0.8
#: Public licence statements, notices and texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("all-rights-reserved", "All rights reserved."),
)
BLANK_LINES = r"\n(?:[\x20\x09\x0B\x0C\x0D]*\n)+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _templates(templates: tuple[tuple[str, str], ...]) -> Column:
    """Literal array of (order, license, bigrams as Spark's xxhash64 gives them, n)."""
    made = []
    for order, (name, text) in enumerate(templates):
        hashes = [int.from_bytes(xxhash.xxh64_digest(b.encode(), 42), "big", signed=True) for b in template_bigrams(text)]
        made.append(
            F.struct(
                F.lit(-order).alias("order"),
                F.lit(name).alias("license"),
                F.array(*[F.lit(h).cast("long") for h in hashes]).alias("bigrams"),
                F.lit(len(hashes)).alias("n"),
            )
        )
    return F.array(*made)


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit (line, block or text), place and content of every unit."""
    text = text_or_empty("text")
    blocks = F.split(text, BLANK_LINES)
    unit = lambda kind, place, content: F.struct(F.lit(kind).alias("unit"), place.cast("long").alias("place"), content.alias("content"))
    lines = F.transform(F.split(text, "\n"), lambda x, i: unit("line", i, x))
    several = F.filter(F.transform(blocks, lambda x, i: unit("block", i, x)), lambda u: F.contains(u["content"], F.lit("\n")))
    whole = F.when(F.size(blocks) > 1, F.array(unit("text", F.lit(0), text))).otherwise(F.slice(F.array(unit("text", F.lit(0), text)), 1, 0))
    return docs.select("doc_id", F.explode(F.concat(lines, several, whole)).alias("u")).select("doc_id", "u.*")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, place, license and dice of every unit of ``docs(doc_id, text)`` that matches a template."""
    cleaned = F.trim(F.regexp_replace(lower_ascii(F.col("content")), r"[^\p{L}\p{N}]+", " "))
    words = F.col("words")
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.xxhash64(F.concat(w, F.lit(" "), F.get(words, i + 1))))
    split = pinned(units(docs), words=F.split(cleaned, " ")).filter(F.size(words) > 1)
    bigrams = pinned(split.select("doc_id", "unit", "place", "words"), bigrams=F.array_distinct(pairs))
    n, reach = F.size("bigrams"), (2 - threshold) / threshold
    possible = F.filter(_templates(templates), lambda t: (n <= t["n"] * reach) & (t["n"] <= n * reach))

    def measured(t: Column) -> Column:
        dice = 2.0 * F.size(F.array_intersect("bigrams", t["bigrams"])) / (n + t["n"])
        return F.struct(dice.alias("dice"), t["order"].alias("order"), t["license"].alias("license"))

    best = pinned(bigrams, best=F.array_max(F.transform(possible, measured)))
    return best.filter(F.col("best.dice") >= threshold).select("doc_id", "unit", "place", "best.license", "best.dice")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, template_bigrams(text)))}])" for k, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH templates(template, license, bigrams) AS (VALUES {rows}
), parts AS (
  SELECT doc_id, row_number() OVER () AS document, string_split(coalesce(text, ''), chr(10)) AS lines,
    string_split_regex(coalesce(text, ''), '{BLANK_LINES}') AS blocks, coalesce(text, '') AS text FROM documents
), units AS (
  SELECT document, doc_id, 'line' AS unit, unnest(range(len(lines))) AS place, unnest(lines) AS content FROM parts
  UNION ALL SELECT * FROM (
    SELECT document, doc_id, 'block', unnest(range(len(blocks))), unnest(blocks) AS content FROM parts
  ) WHERE contains(content, chr(10))
  UNION ALL SELECT document, doc_id, 'text', 0, text FROM parts WHERE len(blocks) > 1
), cleaned AS (
  SELECT *, string_split(trim(regexp_replace(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM units
), sets AS (
  SELECT document, doc_id, unit, place, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams
  FROM cleaned WHERE len(words) > 1
), measured AS (
  SELECT s.*, license, template, 2.0::DOUBLE * len(list_intersect(s.bigrams, t.bigrams)) / (len(s.bigrams) + len(t.bigrams)) AS dice
  FROM sets s JOIN templates t ON len(s.bigrams) <= len(t.bigrams) * {(2 - THRESHOLD) / THRESHOLD}::DOUBLE
    AND len(t.bigrams) <= len(s.bigrams) * {(2 - THRESHOLD) / THRESHOLD}::DOUBLE
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document, unit, place ORDER BY dice DESC, template) AS rank FROM measured WHERE dice >= {THRESHOLD}
)
SELECT doc_id, unit, place::BIGINT AS place, license, dice FROM ranked WHERE rank = 1
"""


@query("op2_license_scan", _sql())
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
