"""License scan, with DataFrame functions only.

Texts are cut into overlapping windows of words; a window twice as long as a template and moved by half its
length holds every occurrence whole.  Of a window only the shingles that some template of its length class has can
matter for containment, so the set that is sketched is the window's shingles among those.
MinHash bands of equal sets retrieve templates; equal sets are looked up once, however many windows have
them.  Every retrieved template is verified by its exact shingle containment.

With bands of one row a template is found with probability 1 - (1 - s)^BANDS at similarity s of the sketched
sets.  The worst case is a five-word template alone in a sixteen-word window that is full of other
templates' shingles, s = 1/12: more than 0.999 with 80 bands.  A window that holds one template only has s = containment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .storage import small

SHINGLE = 5
PERCENT = 80
BANDS = 80
LEAST_WINDOW = 16
#: Template shingles handled in one pass over the documents.
BLOCK_SHINGLES = 5000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices by which common licenses are applied, from the public license texts.
LICENSES = [
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def collision_probability(similarity: float, bands: int = BANDS, rows: int = 1) -> float:
    """Chance that two sets of that similarity agree in some band."""
    return 1 - (1 - similarity**rows) ** bands


def _words(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _shingles(words):
    """Hashes of all five-word runs."""
    n = F.size(words)
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(
        F.array().cast("array<long>")
    )


def _bands(items):
    """MinHash keys of a set, one for each band."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(items, lambda h: F.xxhash64(h, b))).alias("key"))
    )


def template_sets(templates: DataFrame, name: str, text: str) -> DataFrame:
    """``template``, ``width`` of its windows and ``items`` (distinct shingles), for templates of five words or more."""
    rows = templates.select(F.col(name).cast("string").alias("template"), _words(F.col(text)).alias("w"))
    rows = rows.filter((F.size("w") >= SHINGLE) & F.col("template").isNotNull())
    width = F.greatest(F.lit(LEAST_WINDOW), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("w").cast("double"))) + 1).cast("int"))
    return rows.select("template", width.alias("width"), F.array_distinct(_shingles(F.col("w"))).alias("items")).distinct()


def license_matches(
    docs: DataFrame,
    templates: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    name: str = "name",
    template_text: str = "text",
) -> DataFrame:
    """Which documents hold which templates.

    A document holds a template if in one of its windows at least 80 percent of the template's distinct five-word shingles
    occur.  Words are runs of letters, digits and characters beyond ASCII, in lower case.  One row for each pair:
    ``doc_id``, ``template``, ``n_shingles`` of the template, ``most_matched`` in one window, ``n_windows`` that
    hold it and ``first_word``, where the first of them begins.

    Null and empty texts and templates of under five words or without a name match nothing; templates of equal name and
    different texts are told apart by their texts and reported together.  Document rows of equal id are reported together.
    Templates are handled in blocks of a bounded number of shingles, each in a pass of its own.
    """
    sets = durable(template_sets(templates, name, template_text))
    numbered = sets.select("width", "template", "items").orderBy("width", "template", "items").toLocalIterator()
    found, block, held = None, [], 0
    for row in numbered:
        if block and (held + len(row["items"]) > BLOCK_SHINGLES):
            one = _block_matches(docs, block, doc_id, text)
            found = one if found is None else found.unionAll(one)
            block, held = [], 0
        block.append(row)
        held += len(row["items"])
    if block or found is None:
        one = _block_matches(docs, block, doc_id, text)
        found = one if found is None else found.unionAll(one)
    best = found.groupBy("doc_id", "template").agg(
        F.max_by("n_shingles", "matched").alias("n_shingles"), F.max("matched").alias("most_matched"),
        F.count_distinct("width", "k").alias("n_windows"), F.min(F.col("k") * F.col("width") / 2).cast("long").alias("first_word"),
    )
    return best


def _block_matches(docs: DataFrame, block: list, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    widths = sorted({r["width"] for r in block})
    longs = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<long>")
    every = {h for r in block for h in r["items"]}
    # the row number also keeps the filter from being pushed below, where it would compute the words again
    rows = docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text)).alias("w"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("which"), _shingles(F.col("w")).alias("h"))
    rows = rows.filter(F.arrays_overlap("h", longs(every)))
    rows = rows.select("doc_id", "which", F.posexplode("h").alias("at", "h")).filter(F.col("h").isin(sorted(every)))
    # the windows of each length class that hold the whole shingle
    places = []
    for width in widths:
        step = width // 2
        mine = {h for r in block if r["width"] == width for h in r["items"]}
        first = F.greatest(F.floor((F.col("at") + SHINGLE - width + step - 1) / step), F.lit(0))
        span = F.transform(F.sequence(first, F.floor(F.col("at") / step)), _in_class(width))
        places.append(F.when(F.col("h").isin(sorted(mine)), span).otherwise(F.array().cast("array<struct<width:int,k:bigint>>")))
    windows = rows.select("doc_id", "which", "h", F.explode(F.concat(*places) if places else F.array().cast("array<struct<width:int,k:bigint>>")).alias("p"))
    windows = windows.groupBy("doc_id", "which", "p.width", "p.k").agg(F.sort_array(F.collect_set("h")).alias("items"))
    windows = durable(windows)
    # templates, at most BLOCK_SHINGLES of them, as literals
    kept = F.array(
        *[F.struct(F.lit(r["template"]).alias("template"), F.lit(r["width"]).alias("width"), longs(r["items"]).alias("t_items")) for r in block]
    ) if block else F.array().cast("array<struct<template:string,width:int,t_items:array<bigint>>>")
    known = spark.range(1).select(F.explode(kept).alias("t")).select("t.*")
    known = known.withColumn("b", F.explode(_bands(F.col("t_items")))).select("template", "width", "t_items", "b.band", "b.key")
    contents = windows.select("width", "items").distinct()
    sketched = contents.withColumn("b", F.explode(_bands(F.col("items")))).select("width", "items", "b.band", "b.key")
    candidates = sketched.join(F.broadcast(known), ["width", "band", "key"]).select("width", "items", "template", "t_items").distinct()
    matched = F.size(F.array_intersect("items", "t_items"))
    verified = candidates.select(
        "width", "items", "template", F.size("t_items").cast("long").alias("n_shingles"), matched.cast("long").alias("matched")
    ).filter(F.col("matched") * 100 >= F.col("n_shingles") * PERCENT)
    return windows.join(small(durable(verified), 10_000), ["width", "items"]).select("doc_id", "template", "n_shingles", "matched", "width", "k")


def _in_class(width: int):
    return lambda k: F.struct(F.lit(width).alias("width"), k.alias("k"))
