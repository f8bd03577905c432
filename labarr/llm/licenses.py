"""License scans with DataFrame functions only.

A positional rare-token index: of every template its words of highest inverse document
frequency (over all scanned documents) are indexed with their positions. A document's
occurrences of indexed words are looked up, each giving the place where the template
would have to begin; a template is found where enough of its indexed words agree on one
place and its mandatory key phrase stands in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import T, ascii_lower

#: Separators of words, as a regular expression's class.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that give a label wherever they stand.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, mandatory key phrase, and text of notices in public use, in words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("lgpl", "the gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "the gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost-1", "distributed under the boost software license", "distributed under the boost software license version 1 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)


def normalised(text: Column) -> Column:
    """A text's words between single blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), F.lit(" "))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " ", -1), lambda w: w != "")


def frequencies(df: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those holding each template word: one small row each."""
    words = sorted({w for _, _, t in templates for w in t.split()})
    line = df.select(normalised(F.col(text)).alias(f"{T}line"))
    held = line.select(F.explode(F.array_append(F.array_distinct(F.filter(F.split(f"{T}line", " ", -1), lambda w: w.isin(words))), F.lit(""))).alias("w"))
    got = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return got.get("", 0), {w: got.get(w, 0) for w in words}


def build_index(counts: dict[str, int], templates=TEMPLATES, rare: int = 6) -> dict[str, list[tuple[int, int]]]:
    """word -> [(template, position)] of each template's ``rare`` words of highest IDF.

    Ties go to the word that sorts first; all positions of a chosen word are postings.
    """
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, text) in enumerate(templates):
        words = text.split()
        chosen = sorted(set(words), key=lambda w: (counts.get(w, 0), w))[:rare]
        for at, w in enumerate(words):
            if w in chosen:
                index.setdefault(w, []).append((t, at))
    return index


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), base=BASE, templates=TEMPLATES, rare: int = 6, agree: float = 0.6) -> DataFrame:
    """Per row: ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0. score is 1 with a base
    label, else the largest share of an accepted template's indexed words found in place,
    else 0. Rows are independent, so ties, repeated rows and further columns change
    nothing; an empty table gives no rows. Nothing is shuffled but the word counts.
    """
    _, counts = frequencies(df, text, templates)
    index = build_index(counts, templates, rare)
    line, words = F.col(f"{T}line"), F.col(f"{T}words")
    rows = df.select(*keep, normalised(F.col(text)).alias(f"{T}line"))
    rows = rows.select(*keep, f"{T}line", _words(line).alias(f"{T}words"))

    # looked-up places: where each template would begin, for each occurrence of an indexed word
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"].isin(list(index)))
    rows = rows.withColumn(f"{T}hits", hits)

    def posted(w: str, at: int) -> Column:
        return F.transform(F.filter(f"{T}hits", lambda x: x["w"] == w), lambda x: x["at"] - at)

    def begins(t: int) -> Column:
        return F.array_sort(F.flatten(F.array(*(posted(w, at) for w, posts in index.items() for u, at in posts if u == t))))

    def most(sorted_places: Column) -> Column:
        """Length of the longest run of equal values."""
        state = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(a: Column, x: Column) -> Column:
            run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

        return F.aggregate(sorted_places, state, step, lambda a: a["best"])

    shares = []
    for t, (_, key, _) in enumerate(templates):
        of = sum(u == t for posts in index.values() for u, _ in posts)
        share = F.when((F.size(f"{T}hits") > 0) & F.contains(line, F.lit(f" {key} ")), most(begins(t)) / F.lit(of)).otherwise(0.0)
        shares.append(F.when(share >= agree, share).otherwise(0.0))
    rows = rows.withColumn(f"{T}shares", F.array(*shares))

    def followed(starts: Column, j: int, w: str) -> Column:
        return F.filter(starts, lambda i: F.coalesce(F.get(words, i + j) == w, F.lit(False)))

    def places(phrase: str) -> Column:
        """Starts of a phrase, in words; only documents that hold it are walked."""
        own = phrase.split()
        every = F.filter(F.transform(words, lambda w, i: F.when(w == own[0], i)), lambda i: i.isNotNull())
        for j, w in enumerate(own[1:], 1):
            every = followed(every, j, w)
        return F.when(F.contains(line, F.lit(f" {phrase} ")), every).otherwise(F.expr("cast(array() as array<int>)"))

    rows = rows.withColumn(f"{T}at", F.array(*(places(p) for p in base)))
    every = F.flatten(f"{T}at")
    found = F.array_compact(F.array(*(F.when(F.size(F.col(f"{T}at")[k]) > 0, F.lit(label)) for k, label in enumerate(base.values()))))
    more = F.array_compact(F.array(*(F.when(F.col(f"{T}shares")[t] > 0, F.lit(label)) for t, (label, _, _) in enumerate(templates))))
    return rows.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(found, more))), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce(F.array_max(f"{T}shares"), F.lit(0.0))).alias("score"),
    )
