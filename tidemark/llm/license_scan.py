"""License scan in DataFrame functions alone: MinHash bands over overlapping windows retrieve templates, exact shingles verify them.

Words are runs of letters and digits, lower-cased; shingles are five words. A template belongs to the size class of the smallest power of two (8 at
least) that holds its words. A text's windows of a class are twice the class long and begin at every multiple of the class, so that any passage of
the template's length lies whole in one of them. A window is given as many one-row bands as find a template of the class that
lies in it (four fifths of its shingles) with probability MISS short of 1. Bands can only collide if the window holds a shingle of a template, so
signatures are worked out for those windows alone; that loses none.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

SHINGLE, CONTAINED, MISS = 5, 0.8, 1e-4

# Notices by which texts name their license.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "mit-line": "Released under the MIT License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def size_class(n_words: int) -> int:
    return max(8, 1 << (n_words - 1).bit_length())


def bands(n_shingles: int, size: int) -> int:
    """One-row bands for a window of 2 * size words that holds CONTAINED of n_shingles: all miss with probability MISS at most."""
    held = math.ceil(CONTAINED * n_shingles)
    jaccard = held / (2 * size - SHINGLE + 1 + n_shingles - held)
    return math.ceil(math.log(MISS) / math.log(1 - jaccard)) if jaccard < 1 else 1


def by_class(templates: dict[str, str]) -> dict[int, dict[str, list[str]]]:
    """Shingles of each template by size class."""
    out: dict[int, dict[str, list[str]]] = {}
    for name, text in templates.items():
        words = template_words(text)
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has less than {SHINGLE} words")
        out.setdefault(size_class(len(words)), {})[name] = shingles(words)
    return dict(sorted(out.items()))


def _hash_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])


def _at(words: Column, i: Column) -> Column:
    return F.array_join(F.slice(words, i + 1, SHINGLE), " ")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment (share of the template's shingles in the best window) and start_word for each text and template found in it.

    A null or empty text, or one of less than five words, has no rows. A repeated row gives its rows again; a null doc_id stays null. Texts are
    scanned whole. No rows or templates give no rows; other columns are ignored. The templates are a parameter of fixed size, so what
    is broadcast is too.
    """
    spark, classes = docs.sparkSession, by_class(templates)
    table = [(size, name, sh) for size, group in classes.items() for name, sh in group.items()]
    known = spark.createDataFrame(table, "size int, license string, shingles array<string>").coalesce(1)
    split = "transform(shingles, s -> split(s, ' '))"
    hashes = known.selectExpr("size", "license", "shingles", f"transform({split}, w -> xxhash64(w[0], w[1], w[2], w[3], w[4])) as hashes")
    parameter = hashes.select("size", "hashes").collect()  # one row a template
    of_class = {size: sorted({h for r in parameter if r["size"] == size for h in r["hashes"]}) for size in classes}
    n_bands = {size: max(bands(len(sh), size) for sh in group.values()) for size, group in classes.items()}
    everything = sorted({h for hs in of_class.values() for h in hs})
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    places = F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(0), F.size("w") - SHINGLE))
    hits = F.filter(places, lambda i: _hash_at(F.col("w"), i).isin(everything))
    # the id keeps the filter from being moved below the split, which would then be done again for every word; written once for all classes
    rows = materialize(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "w", hits.alias("hits")).where(F.size("hits") > 0))
    found = None
    for size, group in classes.items():
        own = F.filter(F.col("hits"), lambda i: _hash_at(F.col("w"), i).isin(of_class[size]))
        starts = F.array_distinct(F.flatten(F.transform(own, lambda i: F.array(F.floor(i / size), F.floor(i / size) - 1))))
        windows = rows.select("doc_id", "row", "w", F.explode(F.filter(starts, lambda k: k >= 0)).alias("k"))
        first = F.col("k") * size
        windows = windows.select("doc_id", "row", (first).cast("int").alias("first"), F.slice("w", (first + 1).cast("int"), 2 * size).alias("w")).where(F.size("w") >= SHINGLE)
        inside = F.sequence(F.lit(0), F.size("w") - SHINGLE)
        windows = windows.withColumn("h", F.transform(inside, lambda i: _hash_at(F.col("w"), i)))
        rank = F.sequence(F.lit(1), F.lit(n_bands[size]))
        least = lambda h: F.transform(rank, lambda b: F.array_min(F.transform(h, lambda x: F.xxhash64(x, b))))
        signed = windows.select("*", F.posexplode(least(F.col("h"))).alias("band", "value"))
        target = hashes.where(F.col("size") == size).select("license", "shingles", F.posexplode(least(F.col("hashes"))).alias("band", "value"))
        met = signed.join(F.broadcast(target), ["band", "value"]).groupBy("row", "doc_id", "first", "license").agg(F.first("w").alias("w"), F.first("shingles").alias("shingles"))
        met = met.withColumn("s", F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: _at(F.col("w"), i)))
        met = met.withColumn("share", F.size(F.array_intersect("shingles", "s")) / F.size("shingles")).where(F.col("share") >= CONTAINED)
        start = F.col("first") + F.array_min(F.transform(F.col("shingles"), lambda s: F.nullif(F.array_position("s", s), F.lit(0)))) - 1
        best = met.groupBy("row", "doc_id", "license").agg(F.max("share").alias("containment"), F.min(start).cast("long").alias("start_word")).drop("row")
        found = best if found is None else found.unionByName(best)
    return found.select("doc_id", "license", F.round("containment", 4).alias("containment"), "start_word")


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """The same by comparing every window with every template."""
    rows = ", ".join(f"('{name}', {size}, {len(sh)}, '{s}')" for size, group in by_class(templates).items() for name, sh in group.items() for s in sh)
    return f"""
WITH t(license, size, n, s) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
i AS (SELECT rid, doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d),
h AS (SELECT rid, doc_id, i, license, size, n, s FROM (SELECT rid, doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM i) JOIN t USING (s)),
k AS (SELECT *, i // size AS k FROM h UNION ALL SELECT *, i // size - 1 FROM h WHERE i >= size),
g AS (SELECT rid, doc_id, license, k, count(DISTINCT s) / n AS share, min(i) AS start_word FROM k WHERE i + 5 <= k * size + 2 * size GROUP BY rid, doc_id, license, k, n HAVING count(DISTINCT s) >= {CONTAINED} * n)
SELECT doc_id, license, round(max(share), 4) AS containment, min(start_word)::BIGINT AS start_word FROM g GROUP BY rid, doc_id, license
"""
