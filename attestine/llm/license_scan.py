"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment confirms them.

DataFrame operations only. Words are maximal runs of letters and digits in lower case, shingles are `WIDTH` words.
Templates are put into classes by their number of shingles; a class whose largest template has m shingles is looked
for in windows of m + m // 4 shingles that start every max(1, m // 4), so that any passage as long as a template lies
whole in some window. A window that holds `share` of a template's shingles has at least a certain Jaccard similarity
with it, and each class has as many one-sample bands as make the chance of a collision at that similarity
GUARANTEE or more. Candidates are confirmed by the share of the template's shingles that the window holds.

A text is looked at only if it holds one of a few words: for each template, words that together stand in so many of
its shingles that a text without them can't hold `share` of the template. This loses nothing and saves the rest.

Defined cases: null or empty text matches nothing; a text shorter than a shingle is one shingle of all its words;
repeated rows give one row for each doc_id and licence, or one each with distinct ids; ties don't matter; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
GUARANTEE = 0.9999

# fixed values: licence statements that are looked for
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-body": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-body": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-body": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of `width` words, in order; of all words if there are fewer; none without words."""
    words = F.split(_plain(text), " ")

    def runs(w: Column) -> Column:
        n = F.greatest(F.size(w) - width + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " ")))

    hashed = F.flatten(F.transform(F.array(words), runs))  # the words are split once
    return F.when(_plain(text) == "", F.array().cast("array<bigint>")).otherwise(hashed)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def needed_words(text: str, share: float, width: int = WIDTH) -> list[str]:
    """Words, long ones first, without which a text holds less than `share` of the shingles of this one."""
    words = _words(text)
    runs = [words[k : k + width] for k in range(max(1, len(words) - width + 1))]
    chosen: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(not set(chosen) & set(r) for r in runs) < math.ceil(share * len(runs) - 1e-9):
            break
        if any(word in r and not set(chosen) & set(r) for r in runs):
            chosen.append(word)
    return chosen


def _classes(templates: dict[str, str], share: float) -> list[dict]:
    """Templates by number of shingles, a factor of two at most within a class."""
    groups: dict[int, dict[str, int]] = {}
    for name, text in templates.items():
        words = _words(text)
        n = len({tuple(words[k : k + WIDTH]) for k in range(max(1, len(words) - WIDTH + 1))})
        groups.setdefault(n.bit_length(), {})[name] = n
    out = []
    for _, members in sorted(groups.items()):
        low, high = min(members.values()), max(members.values())
        step = max(1, high // 4)
        window = high + step - 1
        hold = math.ceil(share * low - 1e-9)
        similar = hold / (window + low - hold)
        bands = 1 if similar >= 1 else math.ceil(math.log(1 - GUARANTEE) / math.log(1 - similar))
        out.append({"names": sorted(members), "step": step, "window": window, "bands": bands})
    return out


def _samples(hashes: Column, bands: Column) -> Column:
    """One MinHash sample for each band."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def windows(docs: DataFrame, templates: dict[str, str], share: float = 0.8) -> DataFrame:
    """doc_id, class, start, window, bands, have: the shingles of each window of texts that can hold a template; one scan for all classes."""
    words = sorted({w for t in templates.values() for w in needed_words(t, share)})
    lowered = F.lower(F.col("text"))
    may = F.lit(False)
    for w in words:
        may = may | F.contains(lowered, F.lit(w))
    kinds = F.array(*[F.struct(F.lit(k).alias("class"), F.lit(c["step"]).alias("step"), F.lit(c["window"]).alias("window"), F.lit(c["bands"]).alias("bands")) for k, c in enumerate(_classes(templates, share))])
    texts = docs.select("doc_id", "text").filter(may).select("doc_id", shingles(F.col("text")).alias("runs")).filter(F.size("runs") > 0)
    each = texts.withColumn("kind", F.explode(kinds)).select("doc_id", "runs", "kind.*")
    placed = each.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("runs"), F.col("step"))))
    return placed.select("doc_id", "class", "start", "window", "bands", F.slice("runs", F.col("start"), F.col("window")).alias("have"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """doc_id, license, containment (the best), n_windows, first_word, last_word for each licence found in a document."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if not templates:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long, first_word long, last_word long")
    named = spark.createDataFrame([(n, templates[n], k, c["bands"]) for k, c in enumerate(_classes(templates, share)) for n in c["names"]], "license string, text string, class int, bands int")
    keys = named.withColumn("want", F.array_distinct(shingles(F.col("text")))).select("class", "license", "want", F.posexplode(_samples(F.col("want"), F.col("bands"))).alias("band", "sample"))
    sampled = windows(docs, templates, share).select("doc_id", "class", "start", "window", "have", F.posexplode(_samples(F.col("have"), F.col("bands"))).alias("band", "sample"))
    near = sampled.join(F.broadcast(keys), ["class", "band", "sample"])  # templates x bands rows
    held = F.size(F.array_intersect("have", "want")) / F.size("want")
    every = near.withColumn("containment", held).filter(F.col("containment") >= share - 1e-9)
    return every.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.countDistinct("start").alias("n_windows"),
        (F.min("start") - 1).cast("long").alias("first_word"), F.max(F.col("start") + F.col("window") + WIDTH - 2).cast("long").alias("last_word"),
    )
