"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, so many that a template's words may stand in it with
as large a share of others as may be missing; blocks begin at every word and pass over line
ends and comment marks. Tokens are ordered by their frequency over all documents, rarest
first. A template's prefix is so many of its rarest tokens that any block with the
threshold's containment holds one of them. Each place of a prefix token meets the templates
of the token; what stands around it has to pass a length filter (enough distinct template
tokens), a positional filter (enough of them from this token on, in the order of both sides)
and, for templates that a few words decide, to hold their naming tokens; then every block
there is intersected exactly. DataFrame operations only.

Defined results: a null text counts as empty, with no words, places or labels and score 0;
a block's repeated tokens count once; rows repeat as they are; an empty table gives an
empty result. A tie between templates keeps all their labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words, once A-Z are lower-cased. Splitting is far cheaper than extracting words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's tokens that a block must hold.
CONTAINMENT = 0.8
#: Templates that are broadcast at most; more are joined by shuffles.
BROADCAST_TEMPLATES = 10_000

#: Phrases whose consecutive words are places, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Templates as label, text and the tokens that must not be missing.
TEMPLATES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", "creative sharealike"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
)


def lowered(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def tokens(text: str = "text") -> Column:
    """Words of a text in order; an empty string may stand at either end."""
    return F.split(lowered(text), GAP)


def n_words(words: Column) -> Column:
    """Number of words in what tokens() gives."""
    ends = (F.element_at(words, 1) == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(words) - ends).cast("long")


def need(tokens: int, containment: float = CONTAINMENT) -> int:
    """Tokens of a template of so many distinct ones that a block must hold."""
    return math.ceil(containment * tokens - 1e-9)


def width(template: str, containment: float = CONTAINMENT) -> int:
    """Words of a template's blocks."""
    return math.ceil(len(template.split()) / containment - 1e-9)


def ordered(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' tokens from rarest to most frequent by the documents that hold them; ties by token."""
    vocabulary = sorted({w for t in templates for w in t[1].split()})
    held = F.array_intersect(tokens(), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()  # as many rows as the templates have words
    count = {r["token"]: r["n"] for r in rows}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Blocks at or over the threshold: (doc_id, key, template, label, start_word, end_word, containment), the best around each place of a prefix token; key tells texts apart."""
    order = ordered(docs, templates)
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for t, (label, text, naming) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        least = need(len(words), containment)
        index += [(word, t, label, least, width(text, containment), words, naming.split(), rank[word]) for word in words[: len(words) - least + 1]]
    spark = docs.sparkSession
    table = spark.createDataFrame(index, "token string, template int, label string, need int, width int, template_words array<string>, naming array<string>, rank int")
    table = F.broadcast(table) if len(templates) <= BROADCAST_TEMPLATES else table
    prefixes = F.array(*map(F.lit, sorted({r[0] for r in index})))
    reach = max((r[4] for r in index), default=1)
    rows = docs.select("doc_id", "text", tokens().alias("all")).where(F.arrays_overlap("all", prefixes))
    rows = rows.select("doc_id", F.md5("text").alias("key"), F.array_remove("all", "").alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda p: F.array_contains(prefixes, F.get("words", p)))
    first = lambda p: F.greatest(F.lit(0), p - (reach - 1))
    near = F.transform(at, lambda p: F.struct(p.alias("at"), first(p).alias("first"), F.slice("words", first(p) + 1, p - first(p) + reach).alias("near")))
    hits = rows.select("doc_id", "key", F.explode(near).alias("x")).select("doc_id", "key", "x.*")
    hits = hits.withColumn("token", F.get("near", F.col("at") - F.col("first"))).join(table, "token")
    # What blocks with this place can hold, as far as the template's width goes.
    begin = F.greatest(F.lit(0), F.col("at") - F.col("first") - (F.col("width") - 1))
    hits = hits.withColumn("near", F.slice("near", begin + 1, F.col("at") - F.col("first") - begin + F.col("width"))).withColumn("first", F.col("first") + begin)
    hits = hits.where(F.size("near") >= F.col("need"))
    ranks = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*[F.lit(k) for k in range(len(order))]))
    hits = hits.withColumn("known", F.array_intersect("near", F.array(*map(F.lit, order))))
    hits = hits.where(F.size("known") >= F.col("need"))
    # Pairs count at their first common token: the tokens left from there on, of the template and of the block, bound the overlap.
    mine = F.size(F.filter("known", lambda w: F.element_at(ranks, w) >= F.col("rank")))
    theirs = F.size(F.filter("template_words", lambda w: F.element_at(ranks, w) >= F.col("rank")))
    hits = hits.where((F.least(mine, theirs) >= F.col("need")) & (F.size(F.array_except("naming", "known")) == 0))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("near") - F.col("width")))

    def block(s: Column) -> Column:
        here = F.slice("near", s + 1, F.col("width"))
        named = F.size(F.array_except("naming", here)) == 0
        return F.struct(F.when(named, F.size(F.array_intersect("template_words", here))).otherwise(0).alias("overlap"), (-s).alias("s"))

    hits = hits.withColumn("best", F.array_max(F.transform(starts, block))).where(F.col("best.overlap") >= F.col("need"))
    start = F.col("first") - F.col("best.s")
    end = F.least(start + F.col("width"), F.col("first") + F.size("near"))
    return hits.select("doc_id", "key", "template", "label", start.alias("start_word"), end.alias("end_word"), (F.col("best.overlap") / F.size("template_words")).alias("containment"))


def places(phrases=PHRASES) -> Column:
    """Array of (start, label) where a phrase's words stand consecutively in the array column ``words``."""

    def of(parts: list[str], label: str) -> Column:
        last = F.size("words") - len(parts)
        every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

        def stands(i: Column) -> Column:
            here = F.col("words")[i] == parts[0]
            for k in range(1, len(parts)):
                here = here & (F.col("words")[i + k] == parts[k])
            return here

        return F.transform(F.filter(every, stands), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    found = [of(phrase.split(), label) for phrase, label in phrases]
    return F.concat(*found)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, places, method labels and the largest containment."""
    docs = docs.select("doc_id", "text")
    hits = matches(docs, templates, containment).groupBy("doc_id", "key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    lasts = F.array(*[F.lit(w) for w in sorted({p.split()[-1] for p, _ in phrases})])
    firsts = F.array(*[F.lit(w) for w in sorted({p.split()[0] for p, _ in phrases})])
    rows = docs.select("doc_id", F.md5("text").alias("key"), tokens().alias("all"))
    gate = F.arrays_overlap("all", lasts) & F.arrays_overlap("all", firsts)  # else no phrase can stand there
    rows = rows.select("doc_id", "key", n_words(F.col("all")).alias("n_words"), F.when(gate, F.array_remove("all", "")).otherwise(F.array().cast("array<string>")).alias("words"))
    rows = rows.withColumn("places", places(phrases)).drop("words")
    hits = hits.withColumnsRenamed({"doc_id": "d2", "key": "k2"})
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2")), "left")
    return rows.select("doc_id", "n_words", "places", F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.coalesce("most", F.lit(0.0)).alias("most"))
