"""License scans by diagonal voting, in built-in functions only.

Every rolling word k-gram of a text is hashed and joined to the positions of
that k-gram in the license templates.  A match votes for the diagonal (text
position minus template position) it lies on.  Neighbouring diagonals of a
template merge, so that a few inserted or dropped words do not break a match;
the merged span is verified on the template words that its exact k-grams
cover.  The templates are a small fixed table, so the join's filter (is the
hash one of the template's) runs inside the text's row and only matching
k-grams, with their words, leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreframe.llm.common import let

#: fixed values: phrase and label of the base scan
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: fixed values: label and public notice text
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the Software), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3


def license_words(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(t, _BREAK), "")


def _split(text: str) -> list[str]:
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """``(template, label, size, at, gram)``: every k-gram of the templates."""
    rows = []
    for n, (label, text) in enumerate(templates):
        words = _split(text)
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        rows += [(n, label, len(words), i, words[i:i + k]) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, size int, at int, gram array<string>")


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """Places of the phrases: structs of the first word's position and the label."""
    split = {p: (p.split(" "), label) for p, label in phrases.items()}

    def here(w: Column, i: Column) -> Column:
        out = None
        for parts, label in split.values():
            hit = F.get(w, i) == parts[0]
            for n, part in enumerate(parts[1:], 1):
                hit = hit & (F.get(w, i + n) == part)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out

    last = F.array(*[F.lit(p) for p in sorted({p[-1] for p, _ in split.values()})])
    none = F.array().cast("array<struct<at:int,label:string>>")
    return F.when(~F.arrays_overlap(words, last), none).otherwise(F.filter(
        F.transform(F.sequence(F.lit(0), F.size(words) - 1),
                    lambda i: F.struct(i.alias("at"), here(words, i).alias("label"))),
        lambda x: x["label"].isNotNull()))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
                 k: int = GRAM, max_shift: int = 2, min_cover: float = 0.8) -> DataFrame:
    """One row per document: ``id_col, n_words, n_base, first_word,
    last_word, base_labels, labels, score`` and ``spans``, the verified spans
    ``(label, start, end, cover)`` in words.

    A template matches where merged diagonals at most ``max_shift`` apart
    cover at least ``min_cover`` of its words.  ``score`` is the best cover,
    and 1 where a phrase stands.

    Null or empty text: no words, no labels (empty strings), score 0.  Null
    ids and repeated rows: scanned like any row.  Equal spans of equal labels
    are listed once.  Empty table: no rows.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates or TEMPLATES, k)
    phrases = phrases or PHRASES
    wanted = [r[0] for r in grams.select(F.xxhash64(*[F.col("gram")[i] for i in range(k)])).distinct().collect()]

    def matches(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - k),
                      lambda i: F.xxhash64(*[F.get(w, i + n) for n in range(k)]).isin(wanted))
        return F.when(F.size(w) >= k, F.transform(at, lambda i: F.struct(
            i.alias("pos"), F.slice(w, i + 1, k).alias("words"))))

    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content"),
                    F.col(text_col).alias("text"))
    base = d.select("id", "content", let(license_words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), phrase_places(w, phrases).alias("places"))).alias("b"))
    votes = (d.select("id", "content", F.explode(let(license_words(F.col("text")), matches)).alias("m"))
             .join(F.broadcast(grams), F.col("m.words") == F.col("gram"))  # the given templates only
             .select("id", "content", "template", "label", "size", "at", F.col("m.pos").alias("pos"))
             .distinct())  # repeated rows vote once
    diagonals = (votes.groupBy("id", "content", "template", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal"))
                 .agg(F.collect_set("at").alias("ats"), F.min("pos").alias("start"), F.max("pos").alias("end")))
    by = Window.partitionBy("id", "content", "template").orderBy("diagonal")
    merged = (diagonals
              .withColumn("jump", (F.col("diagonal") - F.lag("diagonal", 1).over(by) > max_shift).cast("int"))
              .withColumn("block", F.sum(F.coalesce("jump", F.lit(0))).over(by))
              .groupBy("id", "content", "template", "label", "size", "block")
              .agg(F.flatten(F.collect_list("ats")).alias("ats"), F.min("start").alias("start"),
                   (F.max("end") + k).alias("end")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (k - 1))))))
    found = (merged.withColumn("cover", covered / F.col("size"))
             .groupBy(F.col("id").alias("f_id"), F.col("content").alias("f_content"))
             .agg(F.max("cover").alias("best"),
                  F.sort_array(F.collect_set(F.when(F.col("cover") >= min_cover, F.struct(
                      "start", "end", "label", "cover")))).alias("spans")))
    places = F.col("b.places")
    named = F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"])))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,cover:double>>"))
    return (base.join(found, base["id"].eqNullSafe(F.col("f_id")) & (F.col("content") == F.col("f_content")), "left")
            .select(F.col("id").alias(id_col), F.col("b.n_words").alias("n_words"),
                    F.size(places).cast("long").alias("n_base"),
                    F.array_min(F.transform(places, lambda x: x["at"])).cast("long").alias("first_word"),
                    F.array_max(F.transform(places, lambda x: x["at"])).cast("long").alias("last_word"),
                    F.array_join(named, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(named, F.transform(spans, lambda x: x["label"]))), ",").alias("labels"),
                    F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
                    spans.alias("spans")))
