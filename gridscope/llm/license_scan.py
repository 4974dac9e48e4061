"""License notices in documents, found by MinHash bands over windows and verified exactly.

A document's word shingles are cut into overlapping windows. A window has a MinHash signature
in bands; a band shared with a window of a template retrieves the template, and the share of
the template's shingles that the document holds decides. All of it happens in the document's
own row: nothing is shuffled but the matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridscope.llm.common import text_or_empty

SHINGLE_WORDS = 5
#: Shingles of a window and between window starts. A template of at least WINDOW + STRIDE - 1
#: shingles holds a whole window of any text that quotes it; a shorter one is retrieved by
#: windows of a single shingle, whose signature is the shingle itself.
WINDOW, STRIDE = 8, 4
#: Values of a band.
BAND_ROWS = 2
#: Most band keys that templates may have; they are part of the query's plan.
MAX_KEYS = 100_000

#: Notices by the identifier of their license.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
    " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
    " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required"
    " by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
    " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and"
    " the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
    " the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
    " provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to"
    " use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
    " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall"
    " be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
    " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or"
    " non-commercial, and by any means.",
}


def bands_needed(similarity: float, rows: int, probability: float) -> int:
    """Bands of ``rows`` values that windows of this similarity share one of with this probability."""
    return math.ceil(math.log(1.0 - probability) / math.log(1.0 - similarity**rows))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle_hashes(docs: DataFrame) -> DataFrame:
    """``__shingles``: hashes of the shingles of ``__words``, in order."""
    def joined(left: Column, right: Column, shift: int) -> Column:
        n = F.size(right) - shift
        return F.when(n > 0, F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: F.xxhash64(a, b))).otherwise(
            F.array().cast("array<bigint>")
        )
    docs = docs.withColumn("__h1", F.transform("__words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("__h2", joined(F.col("__h1"), F.col("__h1"), 1))
    docs = docs.withColumn("__h4", joined(F.col("__h2"), F.col("__h2"), 2))
    return docs.withColumn("__shingles", joined(F.col("__h4"), F.col("__h1"), 4)).drop("__h1", "__h2", "__h4")


def _keyed(docs: DataFrame, bands: int, stride: int) -> DataFrame:
    """``__keys``: the band keys of a text's windows of WINDOW shingles, from ``__shingles``."""
    n = F.size("__shingles")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - F.lit(WINDOW - 1), F.lit(stride))).otherwise(F.array().cast("array<int>"))

    def reordered(k: int) -> Column:
        """The shingles' hashes in the ``k``-th order: another order of the same numbers."""
        return F.transform("__shingles", lambda h: h.bitwiseXOR(F.xxhash64(F.lit(f"order {k}"))))

    def least(k: int) -> Column:
        # The reordered hashes are bound to a name, so that they are made once and not per window.
        return F.transform(F.array(reordered(k)), lambda h: F.transform(starts, lambda at: F.array_min(F.slice(h, at, F.lit(WINDOW)))))[0]

    def band(k: int) -> Column:
        return F.zip_with(f"__least{2 * k}", f"__least{2 * k + 1}", lambda x, y: F.xxhash64(F.lit(k), x, y))

    values = range(bands * BAND_ROWS)
    for k in values:
        docs = docs.withColumn(f"__least{k}", least(k))
    return docs.withColumn("__keys", F.concat(*[band(k) for k in range(bands)])).drop(*[f"__least{k}" for k in values])


def _shingle_texts(words: Column) -> Column:
    n = F.size(words) - F.lit(SHINGLE_WORDS - 1)
    return F.when(n > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(1), n), lambda at: F.array_join(F.slice(words, at, F.lit(SHINGLE_WORDS)), " ")
    ))).otherwise(F.array().cast("array<string>"))


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", least_percent: int = 80,
    similarity: float = 0.8, probability: float = 0.99,
) -> DataFrame:
    """One row per document and license found: ``key, license, shared, template_shingles, containment``.

    A template is found when the document holds ``least_percent`` of its distinct 5-word
    shingles or more. ``similarity`` and ``probability`` set the number of bands: a window
    that similar to one of a template's retrieves it with at least that probability, and a
    quotation has many windows. Templates of less than one shingle are an error. Null texts
    match nothing; repeated rows are reported each; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    spark, bands = docs.sparkSession, bands_needed(similarity, BAND_ROWS, probability)
    shelf = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("license"), F.lit(v).alias("__text")) for k, v in templates.items()
    ])).alias("t")).select("t.*")
    shelf = _shingle_hashes(shelf.withColumn("__words", words_of(F.col("__text"))))
    long = F.size("__shingles") >= WINDOW + STRIDE - 1
    shelf = _keyed(shelf, bands, 1).select(
        "license", _shingle_texts(F.col("__words")).alias("__wanted"), F.when(long, F.col("__keys")).otherwise(F.col("__shingles")).alias("__keys"),
        long.alias("__long"),
    )
    known = shelf.collect()  # as many rows as templates
    if any(not r["__wanted"] for r in known):
        raise ValueError(f"a template needs {SHINGLE_WORDS} words or more")
    owners: dict[int, set[str]] = {}
    for r in known:
        for k in r["__keys"]:
            owners.setdefault(k, set()).add(r["license"])
    if len(owners) > MAX_KEYS:
        raise ValueError(f"templates have {len(owners)} band keys, more than {MAX_KEYS}")
    banded = sorted({k for r in known if r["__long"] for k in r["__keys"]})
    single = sorted({k for r in known if not r["__long"] for k in r["__keys"]})
    rows = docs.select(F.col(key), words_of(text_or_empty(text)).alias("__words"))
    rows = _keyed(_shingle_hashes(rows), bands, STRIDE)

    def hits(keys: str, of: list[int]) -> Column:
        return F.filter(keys, lambda k: k.isin(of)) if of else F.array().cast("array<bigint>")

    rows = rows.select(key, "__words", F.array_distinct(F.concat(hits("__keys", banded), hits("__shingles", single))).alias("__hits"))
    # Rows without a hit are not filtered out: a filter would be pushed below the columns it is
    # made of and repeat them. The templates travel as one literal each; there are as many as the caller gave.
    found = F.array(*[
        F.when(
            F.arrays_overlap("__hits", F.array(*[F.lit(k).cast("long") for k in sorted(k for k, who in owners.items() if r["license"] in who)])),
            F.struct(
                F.lit(r["license"]).alias("license"),
                F.size(F.array_intersect("__texts", F.array(*[F.lit(w) for w in r["__wanted"]]))).cast("long").alias("shared"),
                F.lit(len(r["__wanted"])).cast("long").alias("template_shingles"),
            ),
        ) for r in known
    ])
    return (
        rows.withColumn("__texts", F.when(F.size("__hits") > 0, _shingle_texts(F.col("__words"))))
        .select(key, F.explode_outer(F.when(F.size("__hits") > 0, found)).alias("m")).where("m is not null")
        .where(F.lit(100) * F.col("m.shared") >= F.lit(least_percent) * F.col("m.template_shingles"))
        .select(key, "m.*", (F.col("m.shared") / F.col("m.template_shingles")).alias("containment"))
    )


def reference_sql(templates: dict[str, str] | None = None, least_percent: int = 80) -> str:
    """The same matches by comparing every document with every template, in DuckDB SQL."""
    templates = TEMPLATES if templates is None else templates
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in templates.items())
    shingles = r"""
  SELECT {id}, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS s
  FROM (SELECT {id}, [x FOR x IN regexp_split_to_array(lower({text}), '[^\pL\pN]+') IF x <> ''] AS w FROM {of})
"""
    return rf"""
WITH templates(license, body) AS (VALUES {values}),
t AS ({shingles.format(id="license", text="body", of="templates")}),
d AS ({shingles.format(id="doc_id", text="coalesce(text, '')", of="documents")}),
n AS (SELECT license, count(*) AS template_shingles FROM t GROUP BY license)
SELECT d.doc_id, t.license, count(*) AS shared, any_value(template_shingles) AS template_shingles,
       count(*) / any_value(template_shingles) AS containment
FROM d JOIN t USING (s) JOIN n USING (license)
GROUP BY d.doc_id, t.license
HAVING 100 * count(*) >= {least_percent} * any_value(template_shingles)
"""
