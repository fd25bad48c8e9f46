"""Licence scan in DataFrame operations: sparse TF-IDF cosine to templates, then inheritance along paths.

1. Three kinds of units are compared: lines that hold a licence word with one-line statements, blocks
   (parted by lines without letters or digits) with the paragraphs of standard headers, whole texts with
   complete licence texts (``license_texts/``). Wrapping and comment marks don't matter to the last two.
2. A unit and each template become sparse vectors: term frequency (one plus its logarithm in blocks and
   texts, so that common words don't carry a long text) times the inverse document frequency among the
   templates of the kind; a term that no template has weighs most, so foreign text lowers the cosine.
   Only terms of the unit meet template terms, in a join with the small template table.
3. Blocks and whole texts are taken from the documents that have enough terms of the templates:
   :func:`gate` gives the number below which no cosine can reach ``least``, so none is lost by it.
4. The best complete text at or above ``least`` is a document's own licence, else the best header or line.
   A document is a licence file of its directory by its own cosine to a complete text, or where matching
   lines or blocks hold at least half of its words.
5. A document without own licence takes that of the licence file in the nearest directory above it:
   distinct directories are exploded into their ancestors and joined with the licensed ones; the
   document joins its directory's answer. Directories, not documents, meet in that step, and a hot
   directory is one row in it.

Rows: a null or empty text has no licence of its own; a null path or path part is the root; a row without
id has no own licence; rows that repeat an id are one document. Ties go to the higher cosine, then the
first licence by name, then the first path. Empty tables give no rows; other columns are not read.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short statements and opening clauses of common licences: fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Paragraphs of standard headers, wrapped in many ways in files.
HEADERS = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: Words so common in English that their presence says nothing.
COMMON = frozenset("a an and are as at be by for from has have he her his in is it of on or that the their they this to was were which will with".split())
CANDIDATE = "(?i)licen[sc]e|redistribut|public domain|free of charge|creative commons|subject to the terms"
TERM = "[a-z0-9]+(?:\\.[a-z0-9]+)*"


def full_texts() -> list[tuple[str, str]]:
    """Names and complete licence texts."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def template_table(templates: list[tuple[str, str]], damped: bool = False) -> tuple[list[tuple[int, str, str, float]], list[tuple[str, float]], float]:
    """Unit vectors of the templates by term, inverse frequency by term, and that of any other term."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    frequency = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in frequency.items()}
    vectors = []
    for k, ((name, _), c) in enumerate(zip(templates, counts)):
        x = {t: (1 + math.log(n) if damped else n) * idf[t] for t, n in sorted(c.items())}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vectors += [(k, name, t, v / norm) for t, v in x.items()]
    return vectors, sorted(idf.items()), math.log(1 + len(counts)) + 1


def gate(templates: list[tuple[str, str]], least: float) -> tuple[list[str], int]:
    """Terms outside ``COMMON`` and how many of them a text has at least if its cosine to any template is ``least``.

    By Cauchy and Schwarz the cosine is at most the norm of the part of the template whose terms the text
    has: with all the common words, and the heaviest others first, that takes so many terms.
    """
    vectors: dict[int, dict[str, float]] = {}
    for k, _, term, weight in template_table(templates, damped=True)[0]:
        vectors.setdefault(k, {})[term] = weight
    fewest = []
    for v in vectors.values():
        mass, n = sum(w * w for t, w in v.items() if t in COMMON), 0
        for w in sorted((w for t, w in v.items() if t not in COMMON), reverse=True):
            if mass >= least * least - 1e-6:
                break
            mass, n = mass + w * w, n + 1
        fewest.append(n)
    return sorted({t for v in vectors.values() for t in v} - COMMON), min(fewest, default=0)


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), 0)


def matches(units: DataFrame, key: list[str], least: float, templates: list[tuple[str, str]], damped: bool = False) -> DataFrame:
    """``key, best, words`` of units (``key, terms``) that match a template."""
    spark = units.sparkSession
    vectors, idf, other = template_table(templates, damped)
    weights = spark.createDataFrame(vectors, "template int, license string, term string, weight double")
    inverse = spark.createDataFrame(idf, "term string, idf double")
    counted = units.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))
    # both tables come from the template list, whose size is fixed
    weight = 1 + F.log(F.col("n")) if damped else F.col("n")
    weighed = counted.join(F.broadcast(inverse), "term", "left").withColumn("x", weight * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("n").alias("words"))
    dots = weighed.join(F.broadcast(weights), "term").groupBy(*key, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    found = dots.join(norms, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least)
    return found.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("rank"), "license")).alias("best"), F.max("words").alias("words"))


def own_licenses(docs: DataFrame, least: float, templates: list[tuple[str, str]], headers: list[tuple[str, str]], full: list[tuple[str, str]]) -> DataFrame:
    """``doc_id, own_license, cosine, licensed_words, complete`` of documents that state a licence."""
    key = ["doc_id", "at", "line"]
    docs = docs.where("doc_id is not null")
    lines = (
        docs.where(F.col("text").rlike(CANDIDATE))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(CANDIDATE)).distinct()
        .select("doc_id", "at", F.xxhash64("line").alias("line"), terms(F.col("line")).alias("terms")))
    kinds = [matches(lines, key, least, templates).withColumn("kind", F.lit("line"))]
    opened = docs.select("doc_id", "text", terms(F.col("text")).alias("terms"))

    def passed(units: DataFrame, set_: list[tuple[str, str]]) -> DataFrame:
        known, fewest = gate(set_, least)
        return units.where(F.size(F.array_intersect("terms", F.array(*[F.lit(t) for t in known]))) >= fewest)

    if headers:
        blocks = (
            passed(opened, headers).select("doc_id", F.posexplode(F.split("text", "\n(?:[^A-Za-z0-9\n]*\n)+")).alias("at", "line")).distinct()
            .select("doc_id", "at", F.xxhash64("line").alias("line"), terms(F.col("line")).alias("terms")))
        kinds.append(matches(passed(blocks, headers), key, least, headers, damped=True).withColumn("kind", F.lit("block")))
    if full:
        whole = passed(opened, full).dropDuplicates(["doc_id", "text"]).select("doc_id", F.lit(0).alias("at"), F.xxhash64("text").alias("line"), "terms")
        kinds.append(matches(whole, key, least, full, damped=True).withColumn("kind", F.lit("whole")))
    found = kinds[0]
    for other in kinds[1:]:
        found = found.unionByName(other)
    part = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    best = found.groupBy("doc_id").agg(
        F.min(part("whole", "best")).alias("complete"), F.min("best").alias("part"),
        F.greatest(F.coalesce(F.sum(part("line", "words")), F.lit(0)), F.coalesce(F.sum(part("block", "words")), F.lit(0))).alias("licensed_words"))
    chosen = best.select("doc_id", F.coalesce("complete", "part").alias("best"), "licensed_words", F.col("complete").isNotNull().alias("complete"))
    return chosen.select("doc_id", F.col("best.license").alias("own_license"), (-F.col("best.rank")).alias("cosine"), "licensed_words", "complete")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the root ("") included, nearest first by depth."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above")))


def scan(
    docs: DataFrame, least: float = 0.75, templates: list[tuple[str, str]] = TEMPLATES, headers: list[tuple[str, str]] = HEADERS, full: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """``docs`` has doc_id, path, text. Per document: own licence and cosine, licence by inheritance and its source."""
    docs = docs.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "text")
    files = docs.select("doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), F.size(terms(F.col("text"))).alias("words"))
    own = own_licenses(docs, least, templates, headers, full_texts() if full is None else full)
    known = files.groupBy("doc_id").agg(F.min(F.struct("path", "directory")).alias("at"), F.max("words").alias("words")).where(F.col("doc_id").isNotNull()).select("doc_id", "at.*", "words")
    stated = known.join(own, "doc_id", "left")
    sources = stated.where("own_license is not null and (complete or 2 * licensed_words >= words)").groupBy("directory").agg(
        F.min(F.struct((-F.col("cosine")).alias("rank"), F.col("own_license").alias("license"), F.col("path").alias("source"))).alias("best"))
    licensed = sources.select(F.col("directory").alias("above"), "best.license", "best.source")
    tree = known.select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.depth", "a.above")
    nearest = tree.join(licensed, "above").groupBy("directory").agg(F.max(F.struct("depth", "license", "source")).alias("near")).select(
        "directory", F.col("near.license").alias("near_license"), F.col("near.source").alias("near_source"))
    out = stated.unionByName(files.where("doc_id is null").select("doc_id", "path", "directory", "words"), allowMissingColumns=True).join(nearest, "directory", "left")
    has_own = F.col("own_license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own_license", "near_license").alias("license"), "cosine",
        F.when(has_own, "own").when(F.col("near_license").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(has_own, F.col("path")).otherwise(F.col("near_source")).alias("source_path"))
