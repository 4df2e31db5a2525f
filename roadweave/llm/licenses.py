"""License scans in DataFrame functions alone: MinHash bands over text windows retrieve templates, shingle containment verifies."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed

#: Words a shingle (all of a shorter template's), least share of a template's shingles that a document must hold.
SHINGLE, CONTAINMENT = 5, 0.8
#: Words of a window at most, and windows that a window's length is covered by at each place.
WINDOW, OVERLAP = 40, 4
#: A window with similarity 0.6 to a template's collides in a band with probability 1 - (1 - 0.6**2)**16 = 0.9992, one with 0.8 with 1 - 1e-7.
BANDS, ROWS = 16, 2
#: Shingles of the templates that one pass over the texts looks for, as they stand in the plan as constants and in a broadcast; more take more passes.
PASS_SHINGLES = 50_000

#: Well-known public license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
}


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and whatever is beyond ASCII, after lower-casing A-Z; null texts have none."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def grams(w: Column, k: int) -> Column:
    """A hash of each run of ``k`` words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def bands(g: Column) -> Column:
    """A key of each band's minima over the hashes ``g``."""
    least = lambda n: F.array_min(F.transform(g, lambda x: F.xxhash64(x, F.lit(n))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def _one_of(values: list[int]):
    return lambda x: x.isin(values)


def _at_one_of(g: Column, values: list[int]):
    return lambda i: F.get(g, i).isin(values)


def _starts(n: int, stride: int):
    """Starts on the stride's grid of the windows of n shingles that hold shingle p; a document's first stands for those before it."""
    return lambda p: F.transform(F.sequence(F.floor((p - n + stride) / stride), F.floor(p / stride)), lambda j: F.greatest(j * stride, F.lit(0)))


def _stride(k: int, size: int) -> int:
    return max(1, (size - k + 1) // OVERLAP)


def _templates(spark: SparkSession, templates: dict[str, str]) -> dict[tuple[int, int], list[tuple[str, list[int]]]]:
    """By (words a shingle, words a window): each template's name and shingles. Templates without a word have no place."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("w")).where("size(w) > 0")
    sized = [(r["name"], r["n"]) for r in rows.select("name", F.size("w").alias("n")).collect()]
    out: dict[tuple[int, int], list[tuple[str, list[int]]]] = {}
    for k in sorted({min(SHINGLE, n) for _, n in sized}):
        got = {r["name"]: r["g"] for r in rows.select("name", grams(F.col("w"), k).alias("g")).collect()}
        for name, n in sized:
            if min(SHINGLE, n) == k:
                out.setdefault((k, min(WINDOW, n)), []).append((name, got[name]))
    return out


def _passes(groups: dict[tuple[int, int], list[tuple[str, list[int]]]]) -> list[list[str]]:
    """The templates' names in runs of PASS_SHINGLES shingles at most; a longer template has a pass of its own."""
    out: list[list[str]] = []
    room = 0
    for _, group in sorted(groups.items()):
        for name, g in group:
            if len(g) > room or not out:
                out.append([])
                room = PASS_SHINGLES
            out[-1].append(name)
            room -= len(g)
    return out


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """A row for each id and license found: id, license, n_shared, n_shingles, containment.

    A license is retrieved if a window of a document and one of the template collide in a MinHash band, and reported if
    the document holds at least ``containment`` of the template's shingles, counted exactly. Windows are as long as the
    template, 40 words at most, and overlap to a quarter of their shingles; a window without any template's shingle
    cannot be similar to one and is not formed. Rows of one id are one document: its shingles are those of all of them, each
    counted once, and a license is retrieved if a window of any of them collides. Null and empty texts have no license; rows
    without id are left out; an empty table, or no template, gives none; ids are of any type; other columns play no part.
    """
    spark = df.sparkSession
    groups = _templates(spark, templates)
    kinds = {"license": T.StringType(), "n_shared": T.IntegerType(), "n_shingles": T.IntegerType(), "containment": T.DoubleType()}
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(n, t) for n, t in kinds.items()]])
    if not groups:
        return spark.createDataFrame([], schema)
    if len(passes := _passes(groups)) > 1:
        parts = [scan(df, {n: templates[n] for n in names}, id_col, text_col, containment) for names in passes]
        return functools.reduce(DataFrame.union, parts)
    docs = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where("id IS NOT NULL")
    sizes = sorted({k for k, _ in groups})
    held = {k: sorted({g for (kk, _), group in groups.items() if kk == k for _, gs in group for g in gs}) for k in sizes}
    docs = docs.select("id", *[grams(F.col("w"), k).alias(f"g{k}") for k in sizes])
    # Constants in an IN list of over ten become a hash set, so this is one look-up a shingle.
    # The row number keeps the filter above this projection: pushed into it, it would work the arrays out twice.
    docs = docs.select("*", *[F.filter(f"g{k}", _one_of(held[k])).alias(f"held{k}") for k in sizes], F.monotonically_increasing_id().alias("row"))
    # Few documents hold any: they are kept once, for the windows of all lengths.
    some_held = F.lit(False)
    for k in sizes:
        some_held |= F.size(f"held{k}") > 0
    docs = checkpointed(docs.where(some_held & (F.col("row") >= 0)))
    windows, marks, of_shingles = [], [], []
    for (k, size), group in groups.items():
        n, stride = size - k + 1, _stride(k, size)
        own = sorted({g for _, gs in group for g in gs})
        g = F.col(f"g{k}")
        at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), _at_one_of(g, own))
        # Starts on the stride's grid of the windows that hold a shingle of the template, within the document.
        starts = F.array_distinct(F.flatten(F.transform(at, _starts(n, stride))))
        some = docs.where(F.size(g) > 0).select("id", g.alias("g"), F.explode(starts).alias("start"))
        some = some.select("id", F.slice("g", (F.col("start") + 1).cast("int"), F.lit(n)).alias("g")).where("size(g) > 0")
        windows.append(some.select("id", F.lit(f"{k},{size}").alias("kind"), F.explode(F.array_distinct(bands(F.col("g")))).alias("band")))
        for name, gs in group:
            marks += [(name, f"{k},{size}", gs[i : i + n]) for i in range(0, max(1, len(gs) - n + 1), max(1, stride // 2))]
            of_shingles += [(name, k, x, len(set(gs))) for x in sorted(set(gs))]
    # At most a pass's shingles, or one template's, as windows and one by one.
    of_templates = spark.createDataFrame(marks, "license string, kind string, g array<long>").select("license", "kind", F.explode(F.array_distinct(bands(F.col("g")))).alias("band"))
    of_templates = of_templates.dropDuplicates(["license", "kind", "band"])
    retrieved = functools.reduce(DataFrame.union, windows).join(F.broadcast(of_templates), ["kind", "band"]).select("id", "license").distinct()
    # An id has no more rows after the partial distinct than the templates have shingles, however many rows it had.
    rows = functools.reduce(DataFrame.union, [docs.select("id", F.lit(k).alias("k"), F.explode(f"held{k}").alias("g")) for k in sizes])
    shingles = spark.createDataFrame(of_shingles, "license string, k int, g long, n_shingles int")
    shared = rows.join(F.broadcast(shingles), ["k", "g"]).select("id", "license", "n_shingles", "g").distinct()
    best = shared.groupBy("id", "license", "n_shingles").agg(F.count("*").cast("int").alias("n_shared"))
    best = best.where(F.col("n_shared") >= F.col("n_shingles") * containment).join(retrieved, ["id", "license"], "left_semi")
    return best.select(F.col("id").alias(id_col), "license", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def sql(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same result in DuckDB: every document's share of every template's shingles, without retrieval."""
    values = ",\n".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates.items())
    w = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t0(license, text) AS (VALUES {values}),
t AS (SELECT license, {w} AS w, least({SHINGLE}, len({w})) AS k FROM t0),
tg0 AS (SELECT DISTINCT license, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM t WHERE k > 0)),
tg AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY license)::INTEGER AS n_shingles FROM tg0),
d AS (SELECT doc_id, {w} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dg AS MATERIALIZED (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM tg) WHERE len(w) >= k)
)
SELECT doc_id, license, count(*)::INTEGER AS n_shared, n_shingles, count(*) / n_shingles::DOUBLE AS containment
FROM dg JOIN tg USING (k, g) GROUP BY doc_id, license, n_shingles HAVING count(*) >= n_shingles * {containment}
"""
