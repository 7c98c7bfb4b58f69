"""License notices by diagonal voting, in DataFrame operations only.

All word k-grams of all texts are joined by hash to the positions they have in
a fixed set of templates. A hit at word ``pos`` of a text and ``tpos`` of a
template votes for the diagonal ``pos - tpos``. Diagonals of one template a few
words apart belong to one place with small insertions or deletions; the share
of the template's k-grams found there is its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import bind
from codeloom.llm.common import whole_texts

# Base phrases and public license notices with their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0",
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        "you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license",
    ),
    (
        "gpl-2",
        "you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    (
        "cc-by-nc",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]
K = 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = "".join(chr(c) for r in ((0, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)) for c in range(*r))


def license_words(text: Column) -> Column:
    """Words of digits, ASCII letters (lower-cased) and all characters above ASCII."""
    plain = F.translate(text, _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(plain, " "), "")


def _grams(words: Column) -> Column:
    """Hash of every k-gram in order; none in a text of fewer words."""
    return F.when(
        F.size(words) >= K,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - K),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)]),
        ),
    )


def template_positions(spark: SparkSession) -> DataFrame:
    """``template, label, n_grams, tpos, gram, tgram`` of the fixed templates."""
    values = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    rows = spark.sql(f"select * from values {values} as t(template, label, text)")
    words = rows.withColumn("twords", license_words(F.col("text")))
    placed = words.select("*", F.posexplode(_grams(F.col("twords"))).alias("tpos", "gram"))
    return placed.select(
        "template",
        "label",
        (F.size("twords") - K + 1).alias("n_grams"),
        "tpos",
        "gram",
        F.slice("twords", F.col("tpos") + 1, K).alias("tgram"),
    )


def base_places(words: Column) -> Column:
    """Struct of the base phrases' places: words stand in blanks of their own, so
    neighbouring phrases share none and each word counts two blanks."""

    def blanks(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))

    def of(line: Column) -> Column:
        counts, firsts, lasts, labels = [], [], [], []
        for label, phrase in PHRASES.items():
            n, key = len(phrase.split()), "".join(f" {w} " for w in phrase.split())
            there = F.contains(line, F.lit(key))
            count = (F.length(line) - F.length(F.replace(line, F.lit(key), F.lit("")))) / len(key)
            before = blanks(F.substring_index(line, key, 1)) / 2
            after = blanks(F.substring_index(line, key, -1)) / 2
            counts.append(F.when(there, count).otherwise(0).cast("long"))
            firsts.append(F.when(there, before).cast("long"))
            lasts.append(F.when(there, F.size(words) - after - n).cast("long"))
            labels.append(F.when(there, F.lit(label)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            sum(counts[1:], counts[0]).alias("n_base"),
            F.array_min(F.array(*firsts)).alias("first_word"),
            F.array_max(F.array(*lasts)).alias("last_word"),
            F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        )

    line = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    return bind(line, of)


def license_spans(texts: DataFrame, gap: int = 3) -> DataFrame:
    """Places of templates: ``doc_id, text_key, label, template, first, last, score``.

    The k-grams of a hit are compared word by word, not by hash alone. Equal
    rows vote once, so they have the same places.
    """
    grams = texts.withColumn("words", license_words(F.col("text"))).select(
        "doc_id", "text_key", "words", F.posexplode(_grams(F.col("words"))).alias("pos", "gram")
    )
    # The templates are the fixed list above, a few hundred rows.
    templates = F.broadcast(template_positions(texts.sparkSession))
    same = F.slice("words", F.col("pos") + 1, K) == F.col("tgram")
    hits = (
        grams.join(templates, "gram")
        .filter(same)
        .select("doc_id", "text_key", "label", "template", "n_grams", "pos", "tpos")
        .distinct()
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
    )
    place = ["doc_id", "text_key", "label", "template", "n_grams"]
    along = Window.partitionBy(*place).orderBy("diagonal", "pos")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    merged = hits.withColumn("new", F.when(step <= gap, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(along)
    )
    return (
        merged.groupBy(*place, "run")
        .agg(
            F.min("pos").alias("first"),
            (F.max("pos") + K - 1).alias("last"),
            F.count_distinct("tpos").alias("found"),
        )
        .withColumn("score", F.col("found") / F.col("n_grams"))
        .drop("run", "found", "n_grams")
    )


def scan_licenses(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Base places, labels and score of every document.

    ``labels`` are those of the base phrases and of every template found to at
    least ``threshold``; ``score`` is the best share found of any template. A
    null or empty text has no words, no labels and score 0. Repeated rows and
    null ids are kept. An empty table gives no rows.
    """
    texts = whole_texts(docs).withColumn("text_key", F.xxhash64("text"))
    base = texts.select(
        "doc_id", "text_key", bind(license_words(F.col("text")), base_places).alias("b")
    ).select("doc_id", "text_key", "b.*")
    spans = license_spans(texts)
    verdict = spans.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        F.collect_set(F.when(F.col("score") >= threshold, F.col("label"))).alias("found"),
        F.max("score").alias("score"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return base.join(verdict, same, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
