"""License scans: base phrases, and diagonal voting against license templates.

Every run of GRAM words of every document is joined with the template positions of the same run. Hits of one document and
template with equal place minus template place lie on one diagonal; neighbouring diagonals (at most DRIFT words apart, where words
were put in or left out) are one span. A span is verified by the exact share of the template's words that its hits cover, which
must be at least COVER per cent.

Templates are fixed texts of this module, so their table has a known size and goes to every task. Hits are counted map-side
by diagonal. Null and empty texts have no words, places or labels and score 0. Equal rows get equal rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkassay.llm.words import LETTERS, LOWER, Words, grams, hashed, whole

GRAM = 4
DRIFT = 6
COVER = 60
#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
)
#: Wording of public licenses and of usual notices, by label.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""),
    ("mit", "This software is released under the MIT License"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl", "under the terms of the GNU General Public License"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under the Creative Commons Attribution License"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)


def _words(text: str) -> np.ndarray:
    return np.concatenate([w.hashes for w in hashed(pa.array([text]), LOWER, LETTERS)])


def _base(words: Words, phrases: list[tuple[np.ndarray, str]]) -> list[dict]:
    places: list[list[int]] = [[] for _ in range(words.last - words.first)]
    labels: list[set[str]] = [set() for _ in places]
    for phrase, label in phrases:
        at = whole(words.bounds, len(phrase))
        for j, word in enumerate(phrase):
            at = at[words.hashes[at + j] == word]
        for place, i in zip(at, np.searchsorted(words.bounds, at, "right") - 1, strict=True):
            places[i].append(int(place - words.bounds[i]))
            labels[i].add(label)
    counts = np.diff(words.bounds)
    return [{"n_words": int(counts[i]), "n_base": len(p), "first_word": min(p, default=None), "last_word": max(p, default=None),
             "base_labels": sorted(labels[i])} for i, p in enumerate(places)]


def base_scan(text: Column) -> Column:
    """n_words, n_base, first_word, last_word and base_labels (array) of each text."""
    kind = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>>"
    phrases = [(_words(phrase), label) for phrase, label in PHRASES]
    fields = pa.struct([(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.list_(pa.string()))])

    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([row for words in hashed(texts, LOWER, LETTERS) for row in _base(words, phrases)], fields)

    return F.arrow_udf(compute, kind)(text)


def rolling(text: Column) -> Column:
    """The hashes of all runs of GRAM words, in order."""
    def compute(texts: pa.Array) -> pa.Array:
        values, ends = [], [np.zeros(1, np.int64)]
        for words in hashed(texts, LOWER, LETTERS):
            values.append(grams(words.hashes, GRAM)[whole(words.bounds, GRAM)] if len(words.hashes) >= GRAM else np.zeros(0, np.uint64))
            counts = np.maximum(np.diff(words.bounds) - GRAM + 1, 0)
            ends.append(ends[-1][-1] + np.cumsum(counts))
        flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(flat.view(np.int64)))

    return F.arrow_udf(compute, "array<bigint>")(text)


def template_places(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(gram, template, label, size, place) of every run of GRAM words of the templates."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = _words(text)
        rows += [(int(g), number, label, len(words), place) for place, g in enumerate(grams(words, GRAM).view(np.int64))]
    return spark.createDataFrame(rows, "gram bigint, template int, label string, size int, place int")


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified spans: doc_id, node (hash of the text), template, label, first and last word, share covered."""
    runs = docs.select("doc_id", F.xxhash64("text").alias("node"), F.posexplode(rolling(F.col("text"))).alias("at", "gram"))
    hits = runs.join(F.broadcast(template_places(docs.sparkSession, templates)), "gram")
    diagonals = (hits.groupBy("doc_id", "node", "template", "label", "size", (F.col("at") - F.col("place")).alias("diagonal"))
                 .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")))
    order = Window.partitionBy("doc_id", "node", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1))
    merged = (diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("doc_id", "node", "template", "label", "size", "span")
              .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"),
                   (F.max("last") + GRAM - 1).alias("last")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (GRAM - 1))))))
    return (merged.withColumn("share", covered / F.col("size")).where(F.col("share") * 100 >= COVER)
            .select("doc_id", "node", "template", "label", "first", "last", "share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts and labels of the base phrases, all labels, and a score.

    The score is 1 if a base phrase stands in the text, else the largest share of a verified span, else 0.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("node"), base_scan(F.col("text")).alias("b")).select("doc_id", "node", "b.*")
    found = spans(docs).groupBy("doc_id", "node").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), "own", "share")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("node") == F.col("__node")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("own", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join(labels, ",").alias("labels"), score.alias("score"))
