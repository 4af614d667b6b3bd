"""License scans with DataFrame functions only.

Texts become arrays of hashed five-word shingles and are read in overlapping windows. A window's MinHash bands (one
row each) are looked up among those of the templates' windows; each document and template that meet are then verified
by the exact share of the template's shingles that the document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import let, text_of, window_hashes

# fixed values: license notices, by SPDX identifier
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice-2", "This project is licensed under the MIT License."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "header", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice-2", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "notice-2", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "notice-2", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain."),
)

#: Words of a shingle; shingles of a window and between the starts of windows; bands of one row.
WIDTH, WINDOW, STRIDE, BANDS = 5, 4, 2, 32
#: Least share of a template's shingles in a document.
CONTAINMENT = 0.8


def collision_probability(template_shingles: int) -> float:
    """Least probability that an unedited template of so many shingles meets a window in some band, wherever it is.

    Every run of up to WINDOW - STRIDE + 1 shingles lies whole within a window, also at both ends of a text. A
    template of so many has a Jaccard similarity of its size over WINDOW with that window at least; a longer one
    shares as many shingles with a window of its own at least, one of WINDOW + STRIDE - 1 covers a window. Each band
    hashes anew, so bands miss one another independently: one shingle gives 1 - (3/4)**32 = 0.9999.
    """
    shared = WINDOW if template_shingles >= WINDOW + STRIDE - 1 else min(template_shingles, WINDOW - STRIDE + 1)
    own = min(template_shingles, WINDOW)
    return 1 - (1 - shared / (WINDOW + own - shared)) ** BANDS


def shingles(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return let(words, lambda w: window_hashes(w, WIDTH))


def windows(hashes: Column, stride: int) -> Column:
    """Overlapping windows of an array of hashes, the last of which ends with it; an array without hashes has none."""
    last = F.greatest(F.lit(0), F.size(hashes) - WINDOW)
    starts = F.when(F.size(hashes) > 0, F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.slice(hashes, i + 1, F.lit(WINDOW)))


def end_windows(hashes: Column) -> Column:
    """Shorter windows at the first and the last place: a notice of one shingle there is a window of its own."""
    sizes = F.when(F.size(hashes) > 1, F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size(hashes)) - 1))
    sizes = F.coalesce(sizes, F.array().cast("array<int>"))
    return F.concat(F.transform(sizes, lambda n: F.slice(hashes, F.lit(1), n)), F.transform(sizes, lambda n: F.slice(hashes, -n, n)))


def bands(window: Column) -> Column:
    """The band keys of a window: the least hash of its shingles with the band's number, for each of BANDS bands."""
    numbers = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(numbers, lambda k: F.array_min(F.transform(window, lambda h: F.xxhash64(h, k))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, set of shingles; templates of fewer than five words have none and are left out."""
    rows = spark.createDataFrame([(f"{name}/{part}", name, text) for name, part, text in templates], "template string, license string, text string")
    return rows.select("template", "license", F.array_distinct(shingles(F.col("text"))).alias("own"), shingles(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, template, n_windows and containment of each template that each of ``docs(doc_id, text)`` holds.

    ``n_windows`` counts the document's windows that met the template, ``containment`` is the exact share of its
    different shingles that occur in the document, ``least`` or more. Null and empty texts match nothing. A repeated
    doc_id is told apart by its text, equal rows give one result. The templates are a fixed list, so what is
    broadcast doesn't grow with the data; documents are not shuffled, only the few matches are.
    """
    known = template_table(docs.sparkSession, templates)
    # a band can only agree where window and template share a shingle, so other windows need no bands
    wanted = sorted({h for r in known.select("own").collect() for h in r["own"]})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(text_of().cast("string")).alias("hashes"))
    rows = rows.where(F.exists("hashes", lambda h: h.isin(wanted))).withColumn("text_key", F.xxhash64("hashes"))
    each = rows.select("doc_id", "text_key", "hashes", F.posexplode(F.concat(windows(F.col("hashes"), STRIDE), end_windows(F.col("hashes")))).alias("at", "window"))
    each = each.where(F.exists("window", lambda h: h.isin(wanted)))
    each = each.select("doc_id", "text_key", "hashes", "at", F.posexplode(bands(F.col("window"))).alias("band", "key"))
    keys = known.select("template", F.explode(windows(F.col("hashes"), 1)).alias("window")).select("template", F.posexplode(bands(F.col("window"))).alias("band", "key")).distinct()
    met = each.join(F.broadcast(keys), ["band", "key"])
    own = known.select("template", "license", "own")
    share = F.size(F.array_intersect("hashes", "own")) / F.size("own")
    checked = met.join(F.broadcast(own), "template").select("doc_id", "text_key", "license", "template", "at", share.alias("containment")).where(F.col("containment") >= least)
    found = checked.groupBy("doc_id", "text_key", "license", "template").agg(F.count_distinct("at").alias("n_windows"), F.max("containment").alias("containment"))
    return found.select("doc_id", "license", "template", "n_windows", "containment")
