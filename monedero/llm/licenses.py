"""Licence scan: lines and paragraphs against licence templates, by Dice over word bigrams.

Text is normalised to lower-case ASCII letters and digits. A block can reach the
threshold only against templates whose number of bigrams lies within a fixed ratio
of its own; the others are pruned. A document must also hold one of the anchor
words that any such match needs, which spares nearly all documents the splitting.
Everything is a column expression: no shuffle, and one document's text stays in
its row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import sql_text, tune

THRESHOLD = 0.8
#: Bigrams of all templates together, which travel inside the plan.
MAX_TEMPLATE_BIGRAMS = 20_000

# Licence notices and short licence texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("reserved", "All rights reserved."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bigrams(text: str) -> list[str]:
    words = [w for w in re.split("[^a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest number of bigrams that can reach the threshold against `size` bigrams."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def anchors(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every document with a match holds one.

    A match shares at least the lower bound of a template's bigrams, so it shares one
    of any set that is larger than the rest; the longest word of each such bigram stands for it.
    """
    out = set()
    for _, text in templates:
        grams = sorted(_bigrams(text), key=lambda g: (-max(map(len, g.split())), g))
        need = max(1, _bounds(len(grams), threshold)[0])
        out |= {max(g.split(), key=lambda w: (len(w), w)) for g in grams[: len(grams) - need + 1]}
    return sorted(out)


def _words(text: Column) -> Column:
    plain = F.translate(text, _UPPER, _LOWER)
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")


def scan(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per matching block: doc_id, unit, unit_no, license_id, dice.

    Blocks are the lines of a text and its paragraphs of several lines, numbered from
    0. The template with the highest Dice wins, ties going to the smaller licence and
    then the earlier template. Blocks of fewer than two words match nothing; null and
    empty texts give no rows. Repeated documents give repeated rows.
    """
    tune(docs.sparkSession)
    known = [(name, _bigrams(body)) for name, body in templates]
    known = [(name, grams) for name, grams in known if grams]
    if sum(len(g) for _, g in known) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"templates hold over {MAX_TEMPLATE_BIGRAMS} bigrams; scan them in several calls")
    if not known:
        return docs.select(F.col(key).alias("doc_id"), *(F.lit(None).cast(t).alias(c) for c, t in _OUT)).where("false")
    bounds = [_bounds(len(g), threshold) for _, g in known]
    shelf = F.array(
        *(
            F.struct(
                F.lit(name).alias("name"),
                F.array(*map(F.lit, grams)).alias("grams"),
                F.lit(len(grams)).alias("n"),
                F.lit(lo).alias("lo"),
                F.lit(hi).alias("hi"),
            )
            for (name, grams), (lo, hi) in zip(known, bounds, strict=True)
        )
    )
    candidates = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(
        F.arrays_overlap(_words(F.col("text")), F.array(*map(F.lit, anchors(templates, threshold))))
    )
    units = F.flatten(
        F.array(
            F.transform(F.split("text", "\n"), lambda s, i: F.struct(F.lit("line").alias("unit"), i.alias("no"), s.alias("body"))),
            F.filter(
                F.transform(
                    F.split("text", "\n[ \t\r]*\n"),
                    lambda s, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("no"), s.alias("body")),
                ),
                lambda p: F.instr(p["body"], "\n") > 0,
            ),
        )
    )
    def best(body: Column) -> Column:
        """The best template of a block, by minus its Dice and its name; null if none fits."""
        scored = lambda g: F.transform(
            F.filter(shelf, lambda t: F.size(g).between(t["lo"], t["hi"])),
            lambda t: F.struct(
                (-2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("minus"), t["name"].alias("name")
            ),
        )
        return _let(_words(body), lambda w: _let(_pairs(w), lambda g: F.array_min(scored(g))))

    # One generator holds the whole comparison, so that Spark computes each part once.
    found = F.filter(
        F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), u["no"].alias("no"), best(u["body"]).alias("best"))),
        lambda m: m["best"]["minus"] <= -threshold,
    )
    return candidates.select("doc_id", F.explode(found).alias("m")).select(
        "doc_id",
        F.col("m.unit").alias("unit"),
        F.col("m.no").alias("unit_no"),
        F.col("m.best.name").alias("license_id"),
        (-F.col("m.best.minus")).alias("dice"),
    )


def _let(value: Column, use) -> Column:
    """`use(value)`, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(words: Column) -> Column:
    less = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(
        F.zip_with(F.slice(words, F.lit(1), less), F.slice(words, F.lit(2), less), lambda a, b: F.concat_ws(" ", a, b))
    )


_OUT = (("unit", "string"), ("unit_no", "int"), ("license_id", "string"), ("dice", "double"))


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan as DuckDB SQL: every block against every template."""
    rows = ", ".join(f"({sql_text(name)}, {sql_text(body)})" for name, body in templates)
    words = "list_filter(string_split_regex(translate({0}, '" + _UPPER + "', '" + _LOWER + "'), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    return f"""
WITH t AS (SELECT license_id, {words.format("body")} AS words FROM (VALUES {rows}) v(license_id, body)),
t2 AS (SELECT license_id, {grams} AS g FROM t),
u AS (
  SELECT doc_id, 'line' AS unit, i - 1 AS unit_no, s[i] AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), range(1, len(s) + 1) r(i)
  UNION ALL
  SELECT doc_id, 'paragraph', i - 1, s[i]
  FROM (SELECT doc_id, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS s FROM documents WHERE text IS NOT NULL), range(1, len(s) + 1) r(i)
  WHERE contains(s[i], chr(10))
),
w AS (SELECT doc_id, unit, unit_no, {words.format("body")} AS words FROM u),
b AS (SELECT doc_id, unit, unit_no, {grams} AS g FROM w WHERE len(words) > 1),
m AS (
  SELECT doc_id, unit, unit_no, license_id, 2.0 * len(list_intersect(b.g, t2.g)) / (len(b.g) + len(t2.g)) AS dice
  FROM b JOIN t2 ON len(b.g) BETWEEN len(t2.g) * {threshold} / (2 - {threshold}) - 1e-9 AND len(t2.g) * (2 - {threshold}) / {threshold} + 1e-9
)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, license_id, CAST(dice AS DOUBLE) AS dice FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license_id) AS r FROM m WHERE dice >= {threshold}
) WHERE r = 1
"""
