"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of every document is joined to the places of that pair in the templates. Pairs that agree on the
offset between document and template lie on one diagonal. Neighbouring diagonals are merged in bands as wide as the words that
may be put in or left out in all, a share of ``DRIFT`` of the template; bands overlap by half, so a span that drifts so far lies
in one of them, and none can grow beyond it. A band whose pairs reach the share ``SHARE`` of its template is verified: counted
is the longest chain of pairs that goes forward in the document and in the template. Templates with less than ``FULL`` pairs,
where one pair tells versions apart, and phrases must be there whole, on one diagonal. Pairs are compared as words, not only
as hashes, so a full diagonal is an exact occurrence. A template can be a whole license text.

Nulls: a null text has no words. Ties: labels are sorted; of two bands with the same span the lesser one stays. Repeated
documents get a row each. A very long text is one row of words and then a row for each pair that some template has. Extra columns
go unless kept, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

# Phrases whose every place counts.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
# Well-known sentences of licenses.
SENTENCES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "subject to the terms of the mozilla public license"),
)
#: Words put in or left out, as a share of a sentence's pairs; the share of its pairs that verifies it.
DRIFT, SHARE = 0.2, 0.8
#: Sentences with less pairs must be there with all of them.
FULL = 10


def pairs(phrases: Sequence[tuple[str, str]] = PHRASES, sentences: Sequence[tuple[str, str]] = SENTENCES) -> list[tuple]:
    """(template, label, base, n pairs, place, first word, second word) of all templates."""
    out = []
    for t, (label, said, base) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in sentences]):
        words = said.split()
        if len(words) < 2:
            raise ValueError(f"a template has 2 words at least: {said}")
        out += [(t, label, base, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    return out


def spans(docs: DataFrame, keep: Sequence[str], text: str = "text", phrases=PHRASES, sentences=SENTENCES) -> DataFrame:
    """Rows (rid, kept columns, n_words, template, label, base, size, first, last, share): bands of diagonals, from their first word to
    the one after their last; a document whose first pair is in no template has one more row with a null template."""
    templates = docs.sparkSession.createDataFrame(pairs(phrases, sentences), "template int, label string, base boolean, size int, place int, a string, b string")
    templates = templates.withColumn("gram", F.xxhash64("a", "b")).withColumnRenamed("a", "ta").withColumnRenamed("b", "tb")
    words = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias("rid"), F.regexp_extract_all(C.lowered(F.col(text)), F.lit(C.LETTER_WORDS), F.lit(0)).alias("w"))
    n = F.size("w")
    grams = F.when(n > 1, F.arrays_zip(F.slice("w", F.lit(1), n - 1).alias("a"), F.slice("w", F.lit(2), n - 1).alias("b")))
    rolling = words.select(*[f"k{i}" for i in range(len(keep))], "rid", n.cast("long").alias("n_words"), F.posexplode_outer(grams).alias("at", "g"))
    rolling = rolling.select("*", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.xxhash64("g.a", "g.b").alias("gram")).drop("g")
    # The templates are a constant list of the program, far below any broadcast limit.
    on = [rolling["gram"] == templates["gram"], rolling["a"] == templates["ta"], rolling["b"] == templates["tb"]]
    hits = rolling.join(F.broadcast(templates), on, "left").where("template IS NOT NULL OR coalesce(at, 0) = 0")  # a row for every document
    exact, diagonal = F.col("base") | (F.col("size") < FULL), F.col("at") - F.col("place")
    width = F.ceil(F.col("size") * DRIFT).cast("int")
    band = F.floor(diagonal / width).cast("int")
    hits = hits.withColumn("band", F.explode_outer(F.when(exact, F.array(diagonal)).when(~exact, F.array(band - 1, band))))
    firsts = [*[f"k{i}" for i in range(len(keep))], "n_words", "label", "base", "size"]
    # A band is as long as its template and twice the drift, so the list has a fixed bound.
    found = hits.groupBy("rid", "template", "band").agg(
        *[F.first(c).alias(c) for c in firsts], F.min("at").cast("long").alias("first"), (F.max("at") + 2).cast("long").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("at", (-F.col("place")).alias("back"))))).alias("pairs"),
    )
    places = F.size(F.array_distinct(F.transform("pairs", lambda p: p["back"])))
    chain = F.when(F.col("base") | (F.col("size") < FULL) | (places < F.col("size") * SHARE), places).otherwise(F.size(_longest_chain(F.transform("pairs", lambda p: -p["back"]))))
    found = found.withColumn("share", F.when(F.col("template").isNotNull(), chain / F.col("size")))
    near = W.partitionBy("rid", "template").orderBy("band")
    beside = lambda step: F.when(step("band").over(near) == F.col("band") + (1 if step is F.lead else -1), step("share").over(near))
    best = F.col("base") | (F.col("size") < FULL) | F.col("template").isNull() | ((F.col("share") > F.coalesce(beside(F.lag), F.lit(0.0))) & (F.col("share") >= F.coalesce(beside(F.lead), F.lit(0.0))))
    return found.withColumn("best", best).where("best").select(
        "rid", *[F.col(f"k{i}") for i in range(len(keep))], "n_words", "template", "label", "base", "size", "first", "last", "share"
    )


def _longest_chain(places: Column) -> Column:
    """The least ends of growing chains of every length: as many as the longest strictly growing chain has places."""

    def grow(ends: Column, p: Column) -> Column:
        return F.concat(F.filter(ends, lambda e: e < p), F.array(p), F.slice(F.filter(ends, lambda e: e >= p), F.lit(2), F.size(ends) + 1))

    return F.aggregate(places, F.array().cast("array<int>"), grow)


def licenses(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", **templates) -> DataFrame:
    """One row per document: the kept columns, n_words, n_base, first_word, last_word, base_labels, labels, score (the best
    verified share of a template, 0 without one)."""
    found = spans(docs, keep, text, **templates)
    place = F.col("base") & (F.col("share") == 1)
    verified = place | (~F.col("base") & (F.col("share") >= F.when(F.col("size") < FULL, 1.0).otherwise(SHARE)))
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        found.groupBy("rid").agg(
            *[F.first(f"k{i}").alias(f"k{i}") for i in range(len(keep))], F.first("n_words").alias("n_words"), F.count_if(place).alias("n_base"),
            F.min(F.when(place, F.col("first"))).alias("first_word"), F.max(F.when(place, F.col("first"))).alias("last_word"),
            labels(place).alias("base_labels"), labels(verified).alias("labels"), F.coalesce(F.max(F.when(verified, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
