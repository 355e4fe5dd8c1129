"""License scan by diagonal voting (built-in functions only).

Every place of every document is joined by the hash of the words that start
there to the places of the license templates with the same words. A hit at
document word p and template word t votes for the diagonal p - t. Votes are
summed by diagonal, neighbouring diagonals (a word added or left out shifts
the rest by one) are merged, and a span counts when enough of the template's
words are verified in it. The join compares the words themselves besides the
hash, so every vote is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from skylane.llm.common import text_or_empty

# Phrases whose places are reported as they stand.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# Wording of public licenses, by what a passage is (a notice that names the license, the grant, the
# conditions, the warranty), each label once. KEYS: words of a passage that must stand unbroken, as another license has
# a name that is longer by a word.
KEYS = {
    "notice:agpl": "gnu affero general public license",
    "notice:cc-by-4.0": "commons attribution 4 0",
    "notice:cc-by-nc-4.0-long": "commons attribution noncommercial 4 0",
    "notice:cc-by-nd-4.0": "commons attribution noderivatives 4 0",
    "notice:cc-by-sa-4.0": "commons attribution sharealike 4 0",
    "notice:gpl": "gnu general public license",
    "notice:lgpl": "gnu lesser general public license",
    "text:agpl": "gnu affero general public license",
    "text:gpl": "gnu general public license",
    "text:lgpl": "gnu lesser general public license",
    "warranty:gpl": "gnu general public license",
}
TEMPLATES = [
    ("conditions:apache-2.0", "you must give any other recipients of the work or derivative works a copy of this license and you must "
     "cause any modified files to carry prominent notices stating that you changed the files"),
    ("conditions:bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
     "disclaimer in the documentation and or other materials provided with the distribution"),
    ("conditions:bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission"),
    ("conditions:gpl", "you may convey a work based on the program or the modifications to produce it from the program in the form of source code"),
    ("conditions:isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("conditions:mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("conditions:zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("notice:agpl", "is licensed under the gnu affero general public license version"),
    ("notice:apache-2.0", "licensed under the apache license version 2 0"),
    ("notice:bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("notice:bsl-1.0", "distributed under the boost software license version 1 0"),
    ("notice:cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("notice:cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("notice:cc-by-nc-4.0-long", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("notice:cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("notice:cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("notice:cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("notice:epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("notice:gpl", "is licensed under the gnu general public license version"),
    ("notice:lgpl", "is licensed under the gnu lesser general public license version"),
    ("notice:mit", "released under the mit license"),
    ("notice:mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("text:agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
     "free software foundation"),
    ("text:apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license you may obtain a copy of the license at"),
    ("text:bsd", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("text:bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license"),
    ("text:cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of "
     "affirmer s copyright and related rights"),
    ("text:gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation"),
    ("text:isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted"),
    ("text:lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
     "free software foundation"),
    ("text:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction"),
    ("text:mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("text:unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
     "compile sell or distribute this software"),
    ("text:zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
     "and redistribute it freely"),
    ("warranty:apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any "
     "kind either express or implied"),
    ("warranty:bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
     "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("warranty:gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
     "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("warranty:isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all "
     "implied warranties of merchantability and fitness"),
    ("warranty:mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("warranty:zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
     "for any damages arising from the use of this software"),
]
# lower() changes letters beyond A-Z too, but the only one that becomes an
# ASCII letter by itself is the Kelvin sign; it is made another letter before
KELVIN, OTHER = "\u212a", "\u00e9"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3            # words of a template k-gram; phrases are shorter and use 2
MAX_SHIFT = 2       # diagonals this near belong to one span
MIN_COVER = 0.8     # share of the template's words that a span must hold


def words_of(text: Column) -> Column:
    """The words: runs of digits, letters and non-ASCII characters, lower-cased (templates are ASCII)."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER))), NOT_WORD), "")


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, gram: int = GRAM, keys=KEYS) -> DataFrame:
    """``h, w1, w2, w3, label, base, t, t_words, grams, in_key, t_key``: k-grams of all templates; whether one lies in the
    key words of its template, and how many do.

    A few hundred rows from fixed lists, whatever the size of the corpus: the
    bound that lets the scan broadcast it."""
    rows = []
    for base, entries in ((True, phrases), (False, templates)):
        for label, text in entries:
            w = text.split()
            k = 2 if base else gram
            key = [] if base else keys.get(label, "").split()
            inside = {a + j for a in range(len(w)) if key and w[a:a + len(key)] == key for j in range(len(key) - k + 1)}
            rows += [(i, label, base, len(w), len(w) - k + 1, i in inside, len(inside), w[i], w[i + 1], w[i + 2] if k == 3 else None)
                     for i in range(len(w) - k + 1)]
    schema = "t int, label string, base boolean, t_words int, grams int, in_key boolean, t_key int, w1 string, w2 string, w3 string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("w1", "w2"))


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``doc_id, digest, label, base, t_words, grams, t_key, diag, p, t, in_key, k``: each verified k-gram hit once."""
    w = F.col("words")
    at = lambda i: F.get(w, F.col("p") + i)
    places = docs.select("doc_id", "digest", "words", F.posexplode("words").alias("p", "first"))
    g = F.broadcast(grams.alias("g"))
    same = ((F.xxhash64("first", at(1)) == F.col("g.h")) & (F.col("first") == F.col("g.w1")) & (at(1) == F.col("g.w2"))
            & (F.col("g.w3").isNull() | (at(2) == F.col("g.w3"))))
    return (places.join(g, same)
            .select("doc_id", "digest", "g.label", "g.base", "g.t_words", "g.grams", "g.t_key", (F.col("p") - F.col("g.t")).alias("diag"),
                    "p", "g.t", "g.in_key", F.when(F.col("g.w3").isNull(), 2).otherwise(3).alias("k"))
            .distinct())                                    # repeated rows vote once


def spans(hits: DataFrame, max_shift: int = MAX_SHIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """Verified spans: ``doc_id, digest, label, base, start, stop, cover``.

    Diagonals are merged when they are at most ``max_shift`` apart; the places
    of such diagonals lie within the template's length of each other, as a
    hit at template word t stands at word diagonal + t. Phrases allow no
    shift: all their words must stand on one diagonal, and the key words
    of a template must stand unbroken."""
    key = ["doc_id", "digest", "label", "base", "t_words", "grams", "t_key"]
    diagonals = hits.groupBy(*key, "diag").agg(
        F.count("*").alias("n"), F.min("p").alias("lo"), F.max(F.col("p") + F.col("k")).alias("hi"),
        F.sort_array(F.flatten(F.collect_set(F.sequence(F.col("t"), F.col("t") + F.col("k") - 1)))).alias("ts"),
        F.collect_set(F.when(F.col("in_key"), F.col("t"))).alias("in_key"))
    w = Window.partitionBy(*key).orderBy("diag", "lo")
    far = ((F.col("diag") - F.lag("diag").over(w)) > F.when(F.col("base"), 0).otherwise(max_shift))
    runs = diagonals.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    merged = runs.groupBy(*key, "run").agg(
        F.min("lo").alias("start"), F.max("hi").alias("stop"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("found"),
        F.size(F.array_distinct(F.flatten(F.collect_list("in_key")))).alias("key_found"))
    return (merged.where(F.col("key_found") == F.col("t_key"))
            .select(*key, "start", "stop", (F.col("found") / F.col("t_words")).alias("cover"))
            .where(F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(min_cover))
            .drop("t_words", "grams", "t_key"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """All verified license spans of all documents, places counted in words from 0."""
    return spans(votes(_words(docs, id_col, text_col), template_grams(docs.sparkSession, phrases, templates)))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), words_of(text).alias("words"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per input row: counts, first and last base place, labels, score.

    * null text counts as empty: no words, no labels, score 0;
    * rows that share id and text (repeated rows) each get the same result;
    * an empty table gives an empty result; other columns are ignored.

    ``score`` is the best share of a template's words found (1 for a phrase)."""
    found = scan(docs, id_col, text_col, phrases, templates)
    label = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.when(F.col("base"), F.col("start"))
    per_doc = found.groupBy("doc_id", "digest").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        label(F.when(F.col("base"), F.col("label"))).alias("base_labels"), label(F.col("label")).alias("labels"),
        F.least(F.max("cover"), F.lit(1.0)).alias("score"), F.count("*").alias("n_spans"))
    rows = _words(docs, id_col, text_col).select("doc_id", "digest", F.size("words").cast("long").alias("n_words"))
    a, b = rows.alias("a"), per_doc.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    return a.join(b, on, "left").select(
        "a.doc_id", "a.n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"))
