"""License scan: fixed phrases, and an exact containment join of text blocks with license templates.

A block is a stretch of consecutive words, as long as the template that it is held against, wherever lines end; its set
holds its distinct words.  A block meets a template when it contains at least ``threshold`` of the template's distinct
words, and the words that tell its label from the others; so a wrapped notice is found, and the same words strewn over a
longer text are not.  All template words are
ordered by their number of documents, rarest first, counted over the whole table.  The join then follows the usual
filters, none of which loses a pair:

* prefix: a block that reaches the threshold has one of the template's first ``n - need + 1`` words;
* position: when that word is the template's word at position p, at most ``n - p`` words from it on can be common, so a
  block in which it is the first common word needs ``n - p >= need``;
* length: all blocks around a place lie within one stretch of two template lengths, which must hold ``need`` of its words.

Only then the blocks around the place are counted one by one.  Only DataFrame operations are used.  Template tables come
from the constants below, so their size is known.

Defined results: a null text counts as empty (no words, no labels, score 0); a text shorter than a template is one block;
repeated rows and null ids stay row by row, since labels return to rows by the SHA-256 of the text; of several templates
of one label the best counts; texts of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# What separates words, and the phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    (("cc", "by"), "cc-by"),
    (("general", "public", "license"), "gpl"),
    (("all", "rights", "reserved"), "reserved"),
)
# Labels, and the notices by which public licenses are named in files.
TEMPLATES = (
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("afl-3.0", "Licensed under the Academic Free License version 3.0"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("artistic-2.0", "This library is free software; you can redistribute it under the terms of the Artistic License 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("eupl-1.2", "Licensed under the European Union Public Licence, version 1.2"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-notice", "This work is licensed under the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ms-pl", "This source is subject to the Microsoft Public License"),
    ("ncsa", "Permission is hereby granted to deal with the Software without restriction under the University of Illinois NCSA Open "
             "Source License"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, "
                   "and without a written agreement is hereby granted"),
    ("psf-2.0", "Licensed to the Python Software Foundation under a contributor agreement"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("wtfpl", "Do what the fuck you want to public license"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software."),
)

TELLING = 3


def words_of(text: Column) -> Column:
    """Lower-case words; ``lower`` changes no separator and keeps every other character a word character."""
    return F.filter(F.split(F.lower(text), SEPARATORS, -1), lambda w: w != "")


def template_words() -> list[tuple[str, list[str], list[str]]]:
    """(label, words in their order, words that a block must have) of every template.

    A word that stands in templates of one label only tells it from the others.  Where a template has up to ``TELLING``
    such words, a block must have them all: short notices and variants of one notice differ by a word.
    """
    listed = [(label, "".join(c if c.isalnum() else " " for c in text.lower()).split()) for label, text in TEMPLATES]
    labels: dict[str, set[str]] = {}
    for label, words in listed:
        for w in words:
            labels.setdefault(w, set()).add(label)
    out = []
    for label, words in listed:
        telling = sorted({w for w in words if len(labels[w]) == 1})
        out.append((label, words, telling if len(telling) <= TELLING else []))
    return out


def _phrase_starts(words: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of the phrase, words counted from 0."""
    def here(w: Column, i: Column) -> Column:
        test = w == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            test = test & F.coalesce(F.get(words, i + k) == other, F.lit(False))
        return F.when(test, i)
    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def word_counts(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Documents per template word, over all documents; one row per template word comes back."""
    listed = F.array(*[F.lit(w) for w in vocabulary])
    rows = (docs.select(F.explode(F.array_intersect(words_of(F.col(text)), listed)).alias("word"))
            .groupBy("word").count().collect())
    return {r["word"]: r["count"] for r in rows}


def prefixes(counts: dict[str, int], threshold: float) -> list[tuple]:
    """(label, word, position, n, need, length, words, must) for the prefix of every template, rarest words first."""
    out = []
    for label, words, must in template_words():
        ordered = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        n, need = len(ordered), math.ceil(threshold * len(ordered) - 1e-9)
        out += [(label, w, p, n, need, len(words), ordered, must) for p, w in enumerate(ordered) if n - p >= need]
    return out


def contained_blocks(docs: DataFrame, text: str, keep: tuple[str, ...], threshold: float = 0.8) -> DataFrame:
    """(keep..., place, label, containment): places of rare template words, with the best block around each that meets the
    threshold of the template."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, words, _ in template_words() for w in words})
    front = prefixes(word_counts(docs, text, vocabulary), threshold)
    rare = F.array(*[F.lit(w) for w in sorted({f[1] for f in front})])
    templates = spark.createDataFrame(
        front, "label string, word string, position int, n int, need int, length int, template array<string>, must array<string>")

    def seeds(words: Column) -> Column:
        # most texts have none of the rare words: two hash lookups a word tell, and only the others are walked
        return let(F.array_intersect(words, rare), lambda own: F.when(F.size(own) > 0, F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
            lambda x: F.array_contains(own, x.word))))

    def common(begin: Column, size: Column, of: str = "template") -> Column:
        return F.size(F.array_intersect(of, F.slice("_words", begin + 1, size)))

    def counted(begin: Column) -> Column:
        whole = common(begin, F.col("length"), "must") == F.size("must")
        return F.when(whole, common(begin, F.col("length"))).otherwise(0)

    first = F.greatest(F.col("at") - F.col("length") + 1, F.lit(0))
    # the last block that holds the place; a short text is one block from its begin
    last = F.least(F.col("at"), F.greatest(F.size("_words") - F.col("length"), first))
    best = F.array_max(F.transform(F.sequence(first, last), counted))
    read = docs.select(*keep, let(words_of(F.col(text)), lambda w: F.struct(
        w.alias("words"), seeds(w).alias("seeds"))).alias("_read"))
    found = (read.select(*keep, F.col("_read.words").alias("_words"), F.explode("_read.seeds").alias("_seed"))
             .select(*keep, "_words", "_seed.word", "_seed.at")
             .join(F.broadcast(templates), "word")
             .where(common(first, 2 * F.col("length") - 1) >= F.col("need")))
    return (found.select(*keep, F.col("at").alias("place"), "label", "n", "need", best.alias("_best"))
            .where(F.col("_best") >= F.col("need"))
            .select(*keep, "place", "label", (F.col("_best") / F.col("n")).alias("containment")))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         threshold: float = 0.8) -> DataFrame:
    """One row per input row: ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a phrase stands, else the best containment of a block, else 0.
    """
    work = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    work = work.withColumn("_key", F.sha2("_text", 256))
    found = (contained_blocks(work, "_text", ("_key",), threshold)
             .groupBy("_key").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best")))

    low = F.lower(F.col("_text"))
    might = low.contains(PHRASES[0][0][0])
    for phrase, _ in PHRASES[1:]:
        might = might | low.contains(phrase[-1])
    none = F.expr("cast(array() as array<int>)")

    def measures(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        *[F.when(might, _phrase_starts(words, p)).otherwise(none).alias(f"p{k}")
                          for k, (p, _) in enumerate(PHRASES)])

    base = work.select(*keep, "_key", let(words_of(F.col("_text")), measures).alias("_m"))
    starts = F.concat(*[F.col(f"_m.p{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_m.p{k}") > 0, F.lit(label))
                                       for k, (_, label) in enumerate(PHRASES)]))
    base = base.select(*keep, "_key", F.col("_m.n_words").alias("n_words"), starts.alias("_starts"),
                       labels.alias("_labels"))
    joined = base.join(found, "_key", "left")
    return joined.select(
        *keep, "n_words", F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array("_labels"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(
            "_labels", F.coalesce("_more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("_starts") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
