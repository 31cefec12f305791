"""License scans by diagonal voting.

Every run of ``k`` words of a text is hashed and joined to the places of the same run in the templates (a fixed table, broadcast once its size
is counted); the words themselves must agree too. Matches of one occurrence lie on one diagonal, text place minus template place, or, where
words are put in or left out, on diagonals next to each other. So matches are counted per diagonal, and neighbouring
diagonals (``NEAR`` to either side) are merged. Where their votes could cover a template, the span is verified: the matches of the merged
diagonals are put in the order of the text, and only a chain of them that also rises in the template counts. Its length is the number of
different template places, in order, that the span holds; repeating a part of a template does not add to it.

A phrase (``PHRASES``) must stand word for word, which is all of its places on one diagonal. Sentences (word pairs) and paragraphs (runs of
``PARAGRAPH_WORDS`` words) must be covered by ``COVERED`` of their places.

Only matches are shuffled. A text that holds one phrase a million times gives a million diagonals of its own; they
are counted per task before the shuffle, and a span is verified from the matches of ``2 * NEAR + 1`` diagonals, at most that many
times the length of the template.

Defined cases: a null or empty text has no words, no labels and the score 0; only A-Z is folded, other letters are words' parts as they are;
repeated rows are scanned each; two templates that cover the same words are both found; coverage of exactly ``COVERED`` is
enough; labels are distinct and sorted; a very long text is scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from footfall.llm.rows import addressed, row_number
from footfall.operators.lookup import sized
from footfall.session import stage

#: Phrases that must stand word for word, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences by which common licenses are known, and their labels.
SENTENCES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution": "creative-commons",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Paragraphs of license texts, and their labels.
PARAGRAPHS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software.": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.": "bsd",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific language governing permissions and limitations under the License.": "apache-2.0",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU General Public License for more details.": "gpl-3.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.": "isc",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means.": "unlicense",
}
PARAGRAPH_WORDS = 4
COVERED = 0.8
NEAR = 3
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # For plain ASCII, lower() is the same and much faster.
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, BREAKS), "")


def templates(spark: SparkSession, phrases: dict[str, str], sentences: dict[str, str], paragraphs: dict[str, str]) -> DataFrame:
    """One row per run of ``k`` words of each template."""
    kinds = [(phrases, True, 2), (sentences, False, 2), (paragraphs, False, PARAGRAPH_WORDS)]
    listed = [(text, label, exact, k) for texts, exact, k in kinds for text, label in texts.items()]
    rows = []
    for number, (text, label, exact, k) in enumerate(listed):
        words = re.sub(BREAKS, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()
        if len(words) < k:
            raise ValueError(f"a template of fewer than {k} words: {text!r}")
        runs = [words[at : at + k] for at in range(len(words) - k + 1)]
        rows += [(number, label, exact, k, len(runs), at, run) for at, run in enumerate(runs)]
    schema = "template int, label string, exact boolean, k int, places int, at int, run array<string>"
    return spark.createDataFrame(rows, schema).withColumn("gram", F.xxhash64("run"))


def matches(docs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """``row, template, label, exact, k, places, at, pos, diagonal`` for each run of ``k`` words that a template has."""
    words = docs.select("row", words_of(F.col("text")).alias("words")).filter(F.size("words") >= k)
    shifted = F.arrays_zip(*(F.slice("words", n + 1, 2147483647).alias(f"w{n}") for n in range(k)))
    runs = words.select("row", F.posexplode(shifted).alias("pos", "p")).filter(F.col("p")[f"w{k - 1}"].isNotNull())
    hashed = runs.select("row", "pos", F.array(*(F.col("p")[f"w{n}"] for n in range(k))).alias("run"))
    known = sized(known.filter(F.col("k") == k).withColumnRenamed("run", "own"))
    return hashed.withColumn("gram", F.xxhash64("run")).join(known, "gram").filter(F.col("run") == F.col("own")).select(
        "row", "template", "label", "exact", "k", "places", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal")
    )


def longest_rise(steps: Column) -> Column:
    """``length, start, end`` of a longest chain of steps (pos, minus at; sorted) that rises in both."""
    tail = "struct<at: int, start: int>"
    start = F.struct(
        F.array().cast(f"array<{tail}>").alias("tails"), F.lit(0).alias("length"), F.lit(0).alias("start"), F.lit(0).alias("end")
    )

    def step(state: Column, match: Column) -> Column:
        at = -match["falling"]
        tails = state["tails"]
        lower = F.size(F.filter(tails, lambda t: t["at"] < at))
        begin = F.when(lower == 0, match["pos"]).otherwise(F.get(tails, lower - 1)["start"])
        own = F.struct(at.cast("int").alias("at"), begin.cast("int").alias("start"))
        longer = lower + 1 > state["length"]
        return F.struct(
            F.concat(F.slice(tails, 1, lower), F.array(own), F.slice(tails, lower + 2, F.size(tails) + 1)).alias("tails"),
            F.greatest(state["length"], lower + 1).alias("length"),
            F.when(longer, begin).otherwise(state["start"]).cast("int").alias("start"),
            F.when(longer, match["pos"]).otherwise(state["end"]).cast("int").alias("end"),
        )

    return F.aggregate(steps, start, step)


def spans(found: DataFrame) -> DataFrame:
    """``row, template, label, exact, start, end, coverage``: spans that cover enough of a template."""
    kind = ["row", "template", "label", "exact", "k", "places"]
    votes = found.groupBy(*kind, "diagonal").agg(F.count("*").alias("votes"), F.max("pos").alias("high"))
    shown = ["row", "template", "label", "exact"]
    whole = votes.filter("exact AND votes = places").select(
        *shown, F.col("diagonal").alias("start"), (F.col("high") + F.col("k")).alias("end"), F.lit(1.0).alias("coverage")
    )
    beside = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    enough = F.sum("votes").over(beside) >= COVERED * F.col("places")
    merged = votes.filter("NOT exact").withColumn("enough", enough).filter("enough").select(
        "row", "template", F.col("diagonal").alias("main"), F.explode(F.sequence(F.col("diagonal") - NEAR, F.col("diagonal") + NEAR)).alias("diagonal")
    )
    steps = F.sort_array(F.collect_list(F.struct("pos", (-F.col("at")).alias("falling"))))
    chains = found.filter("NOT exact").join(merged, ["row", "template", "diagonal"]).groupBy(*kind, "main").agg(steps.alias("steps"))
    chains = chains.withColumn("chain", longest_rise(F.col("steps"))).withColumn("coverage", F.col("chain.length") / F.col("places"))
    verified = chains.filter(F.col("coverage") >= COVERED).select(
        *shown, F.col("chain.start").alias("start"), (F.col("chain.end") + F.col("k")).alias("end"), "coverage"
    )
    return whole.unionByName(verified.groupBy(*shown, "start", "end").agg(F.max("coverage").alias("coverage")))


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES, paragraphs: dict[str, str] = PARAGRAPHS,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Spans as in ``spans``, and per row ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    docs = addressed(docs).select(row_number().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = templates(docs.sparkSession, phrases, sentences, paragraphs)
    met = [matches(docs, known, k) for k in (2, PARAGRAPH_WORDS)]
    found = stage(spans(stage(met[0].unionByName(met[1]), "license-matches")), "license-spans")
    base = F.col("exact")
    by_row = found.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = docs.select("row", "id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    per_row = counted.join(by_row, "row", "left").select(
        "row", "id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return found, per_row
