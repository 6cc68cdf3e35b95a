"""License scan: phrases at word positions, and an exact set-similarity join of text blocks with templates.

A template of up to half a block's words is looked for in blocks of that size, one at each multiple of half a block,
so every run of up to half a block lies whole in one. A template is found in a block that holds THRESHOLD of the
template's distinct words. Template words are ordered by how many documents hold them, rarest first; a block that meets
the threshold must hold one of the first |T| - ceil(THRESHOLD * |T|) + 1 of them, so the join is on those few words. A
length filter and a positional filter leave little for the exact overlap to check.

Texts are split into words twice: for a narrow table, whose counts give the order, and for the blocks of all sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import lower_ascii, release, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label of each phrase; all end with LAST.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
LAST = "license"
THRESHOLD = 0.9
#: Halves of the block sizes; a template goes with the first that it fits into.
HALVES = (16, 32, 64, 128)
#: (label, statement): short notices, and the paragraphs that license texts and file headers carry (fixed values).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]
#: Parts that the rows of one text are dealt to where its findings join them.
SALTS = 32


def half_of(statement: str) -> int:
    """Half of the block size for a template: at least as many words as it has."""
    return next(h for h in HALVES if len(statement.split()) <= h)


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null counts as empty."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def phrase_places(words: Column) -> Column:
    """array<struct<first: long, label: string>> of all places of PHRASES."""

    def at(i: Column) -> Column:
        found = []
        for phrase, label in PHRASES.items():
            rest = phrase.split()[:-1]
            same = F.lit(True)
            for back, word in enumerate(reversed(rest), 1):
                same = same & (F.get(words, i - back) == word)
            fits = (i >= len(rest)) & same
            found.append(F.when(fits, F.struct((i - len(rest)).cast("long").alias("first"), F.lit(label).alias("label"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    positions = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == LAST)
    none = F.array().cast("array<struct<first:bigint,label:string>>")
    return F.when(F.array_contains(words, LAST), F.flatten(F.transform(positions, at))).otherwise(none)


def blocks_of(words: Column, half: int) -> Column:
    """Windows of 2 * half words from each multiple of half."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - half), F.lit(half))
    return F.transform(starts, lambda i: F.slice(words, i, 2 * half))


def needed(n: int) -> int:
    """Words of a template of n distinct words that a block must hold."""
    return math.ceil(THRESHOLD * n - 1e-9)


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def prefix_index(counts: dict[str, int]) -> tuple[list[str], list[tuple]]:
    """(template words, rarest first; entries (word, template, label, half, at, n, least, tokens) of the prefixes)."""
    order = sorted(vocabulary(), key=lambda w: (counts.get(w, 0), w))
    place, entries = {w: i for i, w in enumerate(order)}, []
    for number, (label, statement) in enumerate(TEMPLATES):
        tokens = sorted(set(statement.split()), key=place.get)
        least = needed(len(tokens))
        entries += [(tokens[at], number, label, half_of(statement), at, len(tokens), least, tokens) for at in range(len(tokens) - least + 1)]
    return order, entries


def template_matches(texts: DataFrame, order: list[str], entries: list[tuple]) -> DataFrame:
    """key, label, containment of each template found in texts(key, words); one row a key and label at most."""
    index = texts.sparkSession.createDataFrame(entries, "word string, template int, label string, half int, at int, n int, least int, tokens array<string>")
    ordered, rare = F.array(*map(F.lit, order)), F.array(*map(F.lit, sorted({e[0] for e in entries})))
    none = F.array().cast("array<struct<half:int,block:array<string>>>")

    def likely(words: Column) -> Column:
        parts = []
        for half in sorted({e[3] for e in entries}):
            own = F.array(*map(F.lit, sorted({e[0] for e in entries if e[3] == half})))
            some = F.filter(blocks_of(words, half), lambda b: F.arrays_overlap(b, own))  # noqa: B023
            parts.append(F.transform(some, lambda b: F.struct(F.lit(half).alias("half"), F.array_intersect(ordered, b).alias("block"))))  # by global order  # noqa: B023
        return F.when(F.arrays_overlap(words, rare), F.concat(*parts)).otherwise(none)

    blocks = texts.select("key", F.inline(F.transform(F.array("words"), likely)[0]))  # words are made once a text
    pairs = blocks.select("key", "half", "block", F.posexplode("block").alias("where", "word")).join(F.broadcast(index), ["word", "half"])  # a row for each prefix word
    pairs = pairs.where(F.size("block") >= F.col("least"))
    pairs = pairs.where(F.lit(1) + F.least(F.col("n") - F.col("at") - 1, F.size("block") - F.col("where") - 1) + F.least("at", "where") >= F.col("least"))
    found = pairs.withColumn("overlap", F.size(F.array_intersect("block", "tokens"))).where("overlap >= least")
    return found.groupBy("key", "label").agg(F.max(F.col("overlap") / F.col("n")).alias("containment"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text).

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: score is the largest containment of a
    template found, 1 where a phrase stands, else 0. A null or empty text has no words and no labels. Equal texts have
    equal results; null doc_ids and repeated rows stay; other columns are left out; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    split = docs.select("doc_id", key.alias("key"), words_of(F.col("text")).alias("words"))
    first = lambda p: p["first"]
    places = split.withColumn("places", phrase_places(F.col("words")))
    narrow = places.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(F.transform("places", first)).alias("first_word"), F.array_max(F.transform("places", first)).alias("last_word"), F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("base"), F.array_intersect("words", F.array(*map(F.lit, vocabulary()))).alias("held"))
    narrow = stored(narrow, "license-words")
    order, entries = prefix_index(dict(narrow.select(F.explode("held").alias("word")).groupBy("word").count().collect()))  # a row for each template word at most
    rare = sorted({e[0] for e in entries})
    matched = template_matches(docs.select(key.alias("key"), words_of(F.col("text")).alias("words")), order, entries)
    matched = matched.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    matched = matched.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    some = F.arrays_overlap("held", F.array(*map(F.lit, rare)))
    joined = narrow.where(some).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(matched, ["key", "salt"], "left").drop("salt", "key", "held")
    rest = narrow.where(~some).drop("key", "held").withColumns({"more": F.lit(None).cast("array<string>"), "best": F.lit(None).cast("double")})
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    out = joined.unionByName(rest)
    out = out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"), score.alias("score"))
    out = stored(out, "license-labels")
    release(narrow)
    return out
