"""License scans by diagonal voting.

DataFrame operations only.  Every pair of neighbouring words of every text is
hashed and joined with the pairs of a few license templates.  A hit at word `p` of
the text and word `t` of a template votes for the diagonal `p - t`.  Votes are
counted by diagonal, neighbouring diagonals (a word more or less) are merged, and
a span is verified by how many of the template's pairs it covers.  Hits are checked
on the words themselves, so a full diagonal of a short phrase is an exact place.

Null and empty texts have no words and no spans.  Repeated rows get a result each.
Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import ascii_lower

#: Words that must stand consecutively, and the label they mean.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Opening words of common license texts and names, and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
]

#: What separates words: ASCII but for digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _pairs(df: DataFrame, base: list[tuple[str, str]], extra: list[tuple[str, str]]) -> DataFrame:
    """A row for each pair of neighbouring words of each template; a constant of the program."""
    rows = []
    for number, (phrase, _) in enumerate([*base, *extra]):
        w = phrase.split()
        if not 2 <= len(w) <= 64:
            raise ValueError("a template has 2 to 64 words")
        rows += [(number, at, len(w), w[at], w[at + 1]) for at in range(len(w) - 1)]
    table = df.sparkSession.createDataFrame(rows, "template int, t int, size int, tw string, tnext string")
    return table.withColumn("gram", F.xxhash64("tw", "tnext"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: list[tuple[str, str]] = BASE, extra: list[tuple[str, str]] = TEMPLATES, cover: float = 0.8, slack: int = 2) -> DataFrame:
    """Spans of all templates, by document.

    Returns id, n_words, spans (array of template number, first word, last word,
    covered share; those that cover at least `cover`, all pairs for phrases of up
    to six words), best (greatest share), a row for every row of `docs`.
    """
    pairs = _pairs(docs, base, extra)
    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    told = told.select("row", "id", F.size("w").cast("long").alias("n_words"), F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b")).alias("z"))
    grams = told.select("row", "id", "n_words", F.posexplode_outer("z").alias("p", "g")).select("row", "id", "n_words", "p", F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    # every document keeps its first row, so one pass over the texts gives hits and documents without any
    met = grams.withColumn("gram", F.xxhash64("a", "b")).join(F.broadcast(pairs), "gram", "left")
    hit = F.coalesce((F.col("a") == F.col("tw")) & (F.col("b") == F.col("tnext")), F.lit(False))
    met = met.filter(hit | (F.coalesce("p", F.lit(0)) == 0))
    met = met.select("row", "id", "n_words", F.when(hit, F.col("template")).alias("template"), F.when(hit, F.col("size")).alias("size"), F.when(hit, F.col("t")).alias("t"), F.when(hit, F.col("p") - F.col("t")).alias("diagonal")).repartition("row")
    votes = met.groupBy("row", "id", "n_words", "template", "size", "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("at"), F.min("t").alias("low"), F.max("t").alias("high"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    short = F.col("size") <= 6
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    groups = votes.withColumn("new", F.when(apart.isNull() | short | (apart > slack), 1).otherwise(0)).withColumn("group", F.sum("new").over(order))
    spans = groups.groupBy("row", "id", "n_words", "template", "size", "group").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("first"), F.max(F.col("diagonal") + F.col("high") + 1).alias("last"), F.bit_count(F.bit_or("at")).alias("n_at")
    )
    share = F.col("n_at") / (F.col("size") - 1)
    good = F.when(short, F.col("n_at") == F.col("size") - 1).otherwise(share >= cover)
    return spans.groupBy("row", "id", "n_words").agg(
        F.array_sort(F.collect_list(F.when(good, F.struct("template", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), share.alias("share"))))).alias("spans"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), share)), F.lit(0.0)).alias("best"),
    ).drop("row").withColumnRenamed("id", id_col)


def summary(spans: DataFrame, *, id_col: str = "doc_id", base: list[tuple[str, str]] = BASE, extra: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Digest of :func:`scan`: places of base phrases, first and last of them, labels, score."""
    name = F.create_map(*[x for i, (_, label) in enumerate([*base, *extra]) for x in (F.lit(i), F.lit(label))])
    places = F.filter("spans", lambda s: s["template"] < len(base))
    starts = F.transform(places, lambda s: s["first"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: name[s["template"]]))), ",")
    return spans.select(
        id_col, "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(places).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.col("best").alias("score"),
    )
