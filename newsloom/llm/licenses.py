"""Licence scan: diagonal voting between document and template words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import ALNUM, NOT_ALNUM, lower_ascii, written

# Phrases whose places are counted, and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices of public licences, the wording found in source files and on pages.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so",
        "Released under the MIT License",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version",
        "This work is licensed under the GNU General Public License, version 3",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
    ),
    "cc-by-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under CC BY 4.0",
    ),
    "cc-by-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License",
    ),
}
GRAM = 3
#: Diagonals at most this far apart count as one: a few words put in or left out.
SLACK = 3
#: Part of a template's grams that a span has to hold.
COVER = 0.8

IN_WORD = ALNUM.removesuffix("+")
BETWEEN = NOT_ALNUM
PLACE = "(?i)(?<!{w})(?:{p})(?!{w})".format(
    w=IN_WORD, p="|".join(BETWEEN.join(p.split()) for p in PHRASES))


def base(text: Column) -> dict[str, Column]:
    """Counts and places of the fixed phrases.

    No phrase begins with the last word of another one, so places never overlap
    and one scan finds them all; letters match in either case, A-Z only.
    """
    def words(t: Column) -> Column:
        return F.regexp_count(t, F.lit(ALNUM)).cast("long")

    found = F.size("__places") > 0
    # Prefixes are taken by the pattern itself: places count UTF-16 units, substrings characters.
    first = F.regexp_extract(text, PLACE.replace("(?i)", "(?is)^(.*?)"), 1)
    final = F.regexp_extract(text, PLACE.replace("(?i)", "(?is)^(.*)"), 1)
    names = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    label = F.transform("__places", lambda p: F.element_at(
        names, lower_ascii(F.regexp_replace(p, BETWEEN, " "))))
    return {
        "n_base": F.size("__places").cast("long"),
        "first_word": F.when(found, words(first)),
        "last_word": F.when(found, words(final)),
        "base_found": F.array_distinct(label),
    }


def split_words(text: Column) -> Column:
    """Lower-case words; other letters than A-Z may change too, templates have none."""
    return F.filter(F.split(F.lower(text), NOT_ALNUM), lambda w: w != "")


def with_grams(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``n_words`` and ``grams``, the hash of every run of three words in order."""
    rows = rows.withColumn("__hash", F.transform(split_words(text), lambda w: F.xxhash64(w)))
    runs = F.transform("__hash", lambda h, i: F.xxhash64(
        h, F.get("__hash", i + 1), F.get("__hash", i + 2)))
    return rows.withColumns({
        "n_words": F.size("__hash").cast("long"),
        "grams": F.when(F.size("__hash") >= 3, F.slice(
            runs, F.lit(1), F.size("__hash") - 2)).otherwise(F.array().cast("array<bigint>")),
    }).drop("__hash")


def templates(spark: SparkSession, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Rows (template, label, t_pos, gram, n_grams): fixed in size, some hundred rows."""
    rows = [(f"{label}/{i}", label, t) for label, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "template string, label string, body string")
    df = with_grams(df, F.col("body"))
    return df.select("template", "label", F.size("grams").alias("n_grams"),
                     F.posexplode("grams").alias("t_pos", "gram"))


def hits(grams: Column, wanted: list[int]) -> Column:
    """Positions and hashes of the grams that occur in some template."""
    marked = F.transform(grams, lambda h, i: F.when(
        h.isin(wanted), F.struct(i.alias("pos"), h.alias("gram"))))
    return F.filter(marked, lambda x: x.isNotNull())


def spans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Verified template spans: (row, template, label, first, last, cover).

    ``rows`` has a key ``row`` and ``hits``.  These are joined to the template
    positions; votes are counted by diagonal (document position less template
    position), neighbouring diagonals are merged into bands, and a band is a span if
    it holds enough different grams of its template, counted by template position.
    """
    votes = rows.select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.gram")
    votes = votes.join(F.broadcast(known), "gram").withColumn(
        "diagonal", F.col("pos") - F.col("t_pos"))
    lines = votes.groupBy("row", "template", "label", "n_grams", "diagonal").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.collect_set("t_pos").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    bands = lines.withColumn("new", new.cast("int")).withColumn("band", F.sum("new").over(order))
    bands = bands.groupBy("row", "template", "label", "n_grams", "band").agg(
        F.min("first").alias("first"), (F.max("last") + GRAM).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"))
    return bands.withColumn("cover", F.col("held") / F.col("n_grams")).where(
        F.col("cover") >= COVER).drop("held", "n_grams", "band")


def scan(docs: DataFrame, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Per document: counts and places of the base phrases, labels and score.

    ``labels`` adds the labels of the templates found to the base ones; ``score`` is
    the best cover of a template, and 1 where a base phrase stands.  Null text counts
    as empty and has no words.  Rows that repeat with the same id and text have
    the same result each.  Extra columns are ignored.
    """
    known = templates(docs.sparkSession, texts)
    wanted = [r[0] for r in known.select("gram").distinct().collect()]
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    rows = with_grams(rows, F.col("__text")).withColumn(
        "__places", F.regexp_extract_all("__text", F.lit(PLACE), F.lit(0)))
    narrow = written(rows.select(
        F.struct("doc_id", F.xxhash64("__text").alias("h")).alias("row"), "doc_id", "n_words",
        *[c.alias(n) for n, c in base(F.col("__text")).items()],
        hits(F.col("grams"), wanted).alias("hits")), "licence-hits")
    found = spans(narrow, known).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    extra = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0)))
    return narrow.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base_found"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base_found", extra)), ",").alias("labels"),
        score.alias("score"))
