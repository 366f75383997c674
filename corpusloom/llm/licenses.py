"""License scans by diagonal voting, in DataFrame functions alone.

Every rolling word 4-gram of every text is joined by its hash with the 4-grams of
the license templates (a fixed, small table). A hit votes for its diagonal, the
place in the text less the place in the template; neighbouring diagonals are one
alignment with a few words put in or left out. An alignment counts if its votes
cover enough of the template, and of the 4-grams that only its label has (licenses
of one family differ by a word), and if its span is not much longer than the
template. Beside it stand the base phrases, words in a row.

Words are maximal runs of a-z, 0-9 and characters beyond ASCII after A-Z went to
lower case.

Rows: a null or empty text has no words, no labels and score 0; repeated rows give
a row each; an empty table gives an empty table. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4
#: Share of a template's 4-grams that an alignment must hit, the same of those that no other label has, how far apart neighbouring diagonals may lie, and the longest span against the template.
COVER, OWN, DRIFT, STRETCH = 0.6, 0.5, 3, 1.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases (at most K words) and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label and text of each template; a label may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "This software is released under the terms of the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]


def words_of(text: str) -> list[str]:
    """The words of a template, by the same rule as in SQL."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(templates: list[tuple[str, str]] | None = None) -> list[tuple[str, int, int, str, int, int, int]]:
    """Of each 4-gram (joined by blanks) of all templates: template number, place, label, words of the template, whether only its label has it (1 or 0), and how many such the template has."""
    found, labels = [], defaultdict(set)
    for t, (label, text) in enumerate(TEMPLATES if templates is None else templates):
        w = words_of(text)
        grams = [" ".join(w[k : k + K]) for k in range(len(w) - K + 1)]
        found.append((t, label, len(w), grams))
        for g in grams:
            labels[g].add(label)
    alone = lambda g: int(len(labels[g]) == 1)
    return [(g, t, k, label, n, alone(g), sum(map(alone, grams))) for t, label, n, grams in found for k, g in enumerate(grams)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Word count, base phrases, labels and score of every text."""
    spark = df.sparkSession
    grams = spark.createDataFrame(template_grams(templates), "gram string, t int, tpos int, label string, t_words int, own int, t_own int")
    at = F.split("gram", " ")
    # one row for each hash, with all its places: a position of a text joins one row at most
    grams = grams.select(F.xxhash64(*(at[k] for k in range(K))).alias("_h"), F.struct("t", "tpos", "label", "t_words", "own", "t_own").alias("_p")).groupBy("_h").agg(F.collect_list("_p").alias("_places"))

    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    base = df.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words.alias("_w"))
    n = F.size("_w")
    zipped = F.arrays_zip(F.col("_w").alias("w0"), *(F.slice("_w", k + 1, F.greatest(n, F.lit(1))).alias(f"w{k}") for k in range(1, K)))
    rolling = base.select("_id", "_row", n.cast("long").alias("_n"), F.posexplode_outer(zipped).alias("_pos", "_g"))
    rolling = rolling.select("_id", "_row", "_n", "_pos", *(F.col("_g")[f"w{k}"].alias(f"w{k}") for k in range(K)))
    label = F.lit(None).cast("string")
    for phrase, name in PHRASES.items():
        match = F.lit(True)
        for k, word in enumerate(phrase.split(" ")):
            match &= F.col(f"w{k}") == word
        label = F.when(match, name).otherwise(label)
    hashed = F.when(F.col(f"w{K - 1}").isNotNull(), F.xxhash64(*(F.col(f"w{k}") for k in range(K))))
    rolling = rolling.select("_id", "_row", "_n", "_pos", label.alias("_base"), hashed.alias("_h")).join(F.broadcast(grams), "_h", "left")
    # what is kept: hits, and the first position of each text for its word count
    hits = rolling.where("_base is not null or _places is not null or coalesce(_pos, 0) = 0").select("*", F.posexplode_outer("_places").alias("_k", "_t")).drop("_places", "_h")
    once = F.coalesce(F.col("_k"), F.lit(0)) == 0  # a position with several places counts once as a phrase
    phrase = F.when(F.col("_base").isNotNull() & once, F.col("_pos"))
    votes = hits.groupBy("_row", "_id", "_n", F.col("_t.t").alias("_t"), (F.col("_pos") - F.col("_t.tpos")).alias("_diagonal")).agg(
        F.first(F.col("_t.label"), True).alias("_label"), F.first(F.col("_t.t_words"), True).alias("_t_words"), F.first(F.col("_t.t_own"), True).alias("_t_own"), F.count("_t").alias("_votes"), F.sum("_t.own").alias("_own"),
        F.min(F.when(F.col("_t").isNotNull(), F.col("_pos"))).alias("_from"), F.max(F.when(F.col("_t").isNotNull(), F.col("_pos"))).alias("_to"),
        F.count(phrase).alias("_n_base"), F.min(phrase).alias("_first"), F.max(phrase).alias("_last"), F.collect_set("_base").alias("_bases"),
    )
    order = Window.partitionBy("_row", "_t").orderBy("_diagonal")
    apart = F.when(F.col("_diagonal") - F.lag("_diagonal").over(order) <= DRIFT, 0).otherwise(1)
    island = F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        votes.withColumn("_apart", apart).withColumn("_island", island).groupBy("_row", "_id", "_n", "_t", "_island")
        .agg(F.first("_label", True).alias("_label"), F.first("_t_words", True).alias("_t_words"), F.first("_t_own", True).alias("_t_own"), F.sum("_votes").alias("_votes"), F.sum("_own").alias("_own"), F.min("_from").alias("_from"), F.max("_to").alias("_to"),
             F.sum("_n_base").alias("_n_base"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.flatten(F.collect_list("_bases")).alias("_bases"))
    )
    cover = F.least(F.lit(1.0), F.col("_votes") / (F.col("_t_words") - (K - 1)))
    verified = (cover >= COVER) & (F.col("_own") >= OWN * F.col("_t_own")) & (F.col("_to") - F.col("_from") + K <= F.col("_t_words") * STRETCH)
    found = merged.withColumn("_cover", F.when(verified, cover)).withColumn("_label", F.when(verified, F.col("_label")))
    one = found.groupBy("_row", "_id", "_n").agg(
        F.sum("_n_base").alias("n_base"), F.min("_first").cast("long").alias("first_word"), F.max("_last").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_bases")))).alias("_bases"), F.collect_set("_label").alias("_labels"), F.max("_cover").alias("_cover"),
    )
    return one.select(
        F.col("_id").alias(id_col), F.greatest(F.col("_n"), F.lit(0)).alias("n_words"), "n_base", "first_word", "last_word",
        F.array_join("_bases", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_bases", "_labels")), ",").alias("labels"),
        F.round(F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_cover", F.lit(0.0))), 6).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB, with the 4-grams themselves in place of hashes."""
    values = ", ".join(f"('{g}', {t}, {k}, '{label}', {n}, {own}, {t_own})" for g, t, k, label, n, own, t_own in template_grams())
    phrases = " ".join(f"WHEN {' AND '.join(f'w{k} = ' + chr(39) + w + chr(39) for k, w in enumerate(p.split(' ')))} THEN '{name}'" for p, name in PHRASES.items())
    return f"""
WITH grams(gram, t, tpos, label, t_words, own, t_own) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
pos AS (SELECT rid, unnest(range(len(w))) AS p, w FROM docs),
roll AS (SELECT rid, p, w[p+1] AS w0, w[p+2] AS w1, w[p+3] AS w2, w[p+4] AS w3 FROM pos),
base AS (SELECT rid, p, CASE {phrases} END AS label FROM roll),
votes AS (SELECT rid, t, label, t_words, t_own, p - tpos AS d, count(*) AS v, sum(own) AS o, min(p) AS p0, max(p) AS p1 FROM roll JOIN grams ON gram = w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 GROUP BY ALL),
steps AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY rid, t ORDER BY d) <= {DRIFT} THEN 0 ELSE 1 END AS apart FROM votes),
isles AS (SELECT *, sum(apart) OVER (PARTITION BY rid, t ORDER BY d ROWS UNBOUNDED PRECEDING) AS isle FROM steps),
merged AS (SELECT rid, t, label, t_words, t_own, isle, sum(v) AS v, sum(o) AS o, min(p0) AS p0, max(p1) AS p1 FROM isles GROUP BY ALL),
found AS (SELECT rid, label, least(1.0::DOUBLE, v::DOUBLE / (t_words - {K - 1})) AS cover FROM merged WHERE least(1.0::DOUBLE, v::DOUBLE / (t_words - {K - 1})) >= {COVER} AND o >= {OWN} * t_own AND p1 - p0 + {K} <= t_words * {STRETCH}),
bases AS (SELECT rid, count(*) AS n_base, min(p) AS f, max(p) AS l, list_sort(list(DISTINCT label)) AS labels FROM base WHERE label IS NOT NULL GROUP BY rid),
scans AS (SELECT rid, list(DISTINCT label) AS labels, max(cover) AS cover FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(s.labels, [])))), ','), '') AS labels,
  round(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END, 6) AS score
FROM docs LEFT JOIN bases b USING (rid) LEFT JOIN scans s USING (rid)"""
