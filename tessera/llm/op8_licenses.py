"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts and templates are lower-cased words of a-z and 0-9; their shingles are five words (a shorter
template counts as one shingle of its own and must hold five words). A template is cut into pieces of at
most 64 shingles. For each size class of pieces (a power of two c), a text is read in windows of 1.5 c
shingles, c / 2 apart, so that any piece's place in a text lies whole in some window: an exact copy then
shares a third of the shingles of both at least, and one with 80 % of its shingles a quarter. A band is
one MinHash, and there are 64: such a window and piece have a common band with a probability of
1 - 0.75 ** 64 > 0.99999998. Windows that hold no shingle of any template cannot share a MinHash with one
and are left out first. A retrieved template matches if 80 % of its shingles are in the text.

DataFrame functions only. Nulls count as empty texts and match nothing, as do texts of under five words; a
null doc_id is kept; repeated rows give repeated rows; an empty table gives an empty result; other columns
are ignored. A row for each document and template that match.
"""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read

SHINGLE = 5
PIECE = 64
BANDS = 64
THRESHOLD = 0.8

# Wordings of public licence notices.
TEMPLATES = {
    "gpl-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0 line": "Licensed under CC BY-NC 4.0.",
    "mit line": "Released under the MIT License.",
    "apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def template_shingles(templates: dict[str, str]) -> dict[str, list[str]]:
    """The different shingles of each template, as text, in order."""
    out = {}
    for name, text in templates.items():
        words = re.findall("[a-z0-9]+", text.lower())
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has under {SHINGLE} words")
        out[name] = [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    return out


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _held(rows: DataFrame, name: str, value) -> DataFrame:
    """rows with a column that is computed once a row: the optimizer does not write a generator's output out again where it is used."""
    return rows.withColumn("_held", F.explode(F.array(value))).drop(name).withColumnRenamed("_held", name)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, matched, shingles, containment for each document and template that match."""
    spark = docs.sparkSession
    known = template_shingles(templates)
    pieces = [(name, own[a : a + PIECE]) for name, own in known.items() for a in range(0, len(own), PIECE)]
    size_class = [1 << (len(own) - 1).bit_length() for _, own in pieces]
    rng = random.Random(8)
    masks = [rng.getrandbits(63) for _ in range(BANDS)]
    # The templates' hashes and band keys; as many as the templates have words, whatever the tables' size.
    texts = list(dict.fromkeys(s for own in known.values() for s in own))
    value = {r["s"]: r["h"] for r in _rows(spark, [{"s": s} for s in texts], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    bands = [{"c": c, "k": k, "b": min(value[s] ^ mask for s in own), "name": name} for (name, own), c in zip(pieces, size_class, strict=True) for k, mask in enumerate(masks)]
    retrieves: dict[int, list[str]] = {}
    for r in _rows(spark, bands, "c int, k int, b bigint, name string").select(F.xxhash64("c", "k", "b").alias("key"), "name").distinct().collect():
        retrieves.setdefault(r["key"], []).append(r["name"])
    to_templates = F.map_from_arrays(F.lit(list(retrieves)), F.array(*(F.lit(names) for names in retrieves.values())))
    wanted = F.create_map(*(F.lit(x) for name, own in known.items() for x in (name, list(dict.fromkeys(value[s] for s in own)))))

    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")), " ")
    rows = _held(docs.select("doc_id", words.alias("w")), "w", "w").where(F.size("w") >= SHINGLE)
    shingles = F.expr(f"transform(sequence(1, size(w) - {SHINGLE - 1}), i -> xxhash64(array_join(slice(w, i, {SHINGLE}), ' ')))")
    rows = _held(rows, "h", shingles).select("doc_id", "h")
    rows = _held(rows, "hits", F.array_intersect("h", F.lit(list(value.values())))).where(F.size("hits") > 0)
    rows = _held(rows, "at", F.expr("filter(sequence(0, size(h) - 1), i -> array_contains(hits, h[i]))"))
    # The windows around hits, of each class, as (class, the window's shingles).
    rows = _held(rows, "windows", F.concat(*(
        F.expr(f"transform(array_distinct(flatten(transform(at, p -> sequence(int(greatest(0, p - {size - 1} + {step - 1}) div {step}), int(p div {step}))))), s -> struct({c} AS c, slice(h, s * {step} + 1, {size}) AS x))")
        for c in sorted(set(size_class)) for step in (max(1, c // 2),) for size in (c + step,)
    )))
    # All that follows stays in a text's own row: no window or text is moved.
    rows = rows.withColumn("masks", F.lit(masks))
    keys = F.expr("array_distinct(flatten(transform(windows, w -> transform(masks, (m, k) -> xxhash64(w.c, k, array_min(transform(w.x, v -> v ^ m)))))))")
    rows = _held(rows, "met", F.array_intersect(keys, F.lit(list(retrieves)))).where(F.size("met") > 0)
    near = rows.withColumn("names", to_templates).select("doc_id", "h", F.explode(F.expr("array_distinct(flatten(transform(met, k -> names[k])))")).alias("template"))
    near = near.withColumn("want", wanted[F.col("template")])
    counted = _held(near, "matched", F.size(F.array_intersect("want", "h")).cast("long")).select("doc_id", "template", "matched", F.size("want").cast("long").alias("shingles"))
    return counted.withColumn("containment", F.col("matched") / F.col("shingles")).where(F.col("matched") >= F.lit(threshold) * F.col("shingles") - 1e-9)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def sql(templates: dict[str, str] = TEMPLATES) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in templates.items())
    shingles = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
    words = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
WITH t AS (SELECT template, {shingles} AS want FROM (SELECT template, {words} AS w FROM (VALUES {rows}) v(template, text))),
d AS (SELECT doc_id, {shingles} AS h FROM (SELECT doc_id, {words} AS w FROM documents) WHERE len(w) >= 5),
m AS (SELECT doc_id, template, CAST(len(list_intersect(want, h)) AS BIGINT) AS matched, CAST(len(want) AS BIGINT) AS shingles FROM d, t)
SELECT doc_id, template, matched, shingles, CAST(matched AS DOUBLE) / shingles AS containment FROM m WHERE matched >= 0.8 * shingles - 1e-9
"""
