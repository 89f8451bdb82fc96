"""Licence scans by diagonal voting, in DataFrame functions only.

Templates are word sequences: short phrases, which must match whole, and longer notices, of which a part will do. Every
run of K words of a document is hashed and joined to the template positions with the same hash, and the words themselves
are compared. A hit at document word d and template word t is a vote for the diagonal d - t; votes are counted by
document, template and diagonal. A phrase is found where a diagonal has a vote of each of its K-grams.

The diagonals of a notice that lie at most DRIFT apart (words were inserted or left out between them) are merged into
one region, which needs votes for COVER of the notice's words. A region is verified word by word: its hits, as pairs of
words, are chained in the order of document and template, from diagonal to neighbouring diagonal; a chain is a span if
it holds enough of all the notice's words. A word counts as matched together with a neighbour, as part of a K-gram.

All grams of a template vote. The template positions are a fixed table of at most MAX_POSITIONS rows, so they are
broadcast; the document side is cut to hits in the same pass, and only hits are shuffled; they are written once, as both
kinds of template read them. A document is keyed by its id and text hash.

Defined results: a null text is an empty one and has no words. Rows with the same id and text are found alike; ids that
are null or repeated keep their own rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import Scratch

#: Words of a gram.
K = 2
#: Diagonals of words that follow each other in a chain lie at most so far apart.
DRIFT = 3
#: Share of a notice's words that has to be matched, and how many at least.
COVER, LEAST_WORDS = 0.5, 3
MAX_POSITIONS = 10_000

#: Fixed values: (label, words that must all match).
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Fixed values: (label, the opening of the licence's usual notice), matched in part.
NOTICES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-text", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
#: What separates words: ASCII characters that are neither digits nor lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the lower-cased text. (Lower-casing letters beyond A-Z as well changes no boundary, and no letter of a
    template arises from one.)"""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def grams(words: Column) -> Column:
    """Of all runs of K words: (hash, the words)."""
    nexts = [F.slice(words, 1 + j, F.greatest(F.size(words) - (K - 1), F.lit(0))) for j in range(K)]
    run = lambda z: [z[f"w{j}"] for j in range(K)]
    return F.transform(F.arrays_zip(*[n.alias(f"w{j}") for j, n in enumerate(nexts)]), lambda z: F.struct(F.xxhash64(*run(z)).alias("hash"), F.concat_ws(" ", *run(z)).alias("run")))


def templates(spark, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, whole, words, n_grams, t (position), gram, run (its words)."""
    rows = [(i, label, whole, text.split()) for i, (label, text, whole) in enumerate([*((a, b, True) for a, b in phrases), *((a, b, False) for a, b in notices)])]
    if sum(len(r[3]) for r in rows) > MAX_POSITIONS or any(len(r[3]) < K for r in rows):
        raise ValueError(f"templates need {K} words each and {MAX_POSITIONS} in all at most")
    base = spark.createDataFrame(rows, "template int, label string, whole boolean, words array<string>")
    found = base.select("*", F.posexplode(grams(F.col("words"))).alias("t", "g"))
    return found.select("template", "label", "whole", "words", "t", F.col("g.hash").alias("gram"), F.col("g.run").alias("run"), F.count("*").over(Window.partitionBy("template")).alias("n_grams"))


def chains(codes: Column, width: Column, need: Column) -> Column:
    """Of matched words of a region, sorted as document word * 2**16 + template word: (first, last, n) of the longest chains of ``need``
    words and more, at every word where one ends. Words of a chain rise in both places and drift at most DRIFT."""
    shape = "struct<recent:array<struct<d:bigint,t:bigint,first:bigint,n:bigint>>,ends:array<struct<first:bigint,last:bigint,n:bigint>>>"

    def step(s: Column, x: Column) -> Column:
        d, t = F.shiftright(x, 16), x.bitwiseAND(F.lit(0xFFFF))
        before = F.filter(s["recent"], lambda r: (r["d"] < d) & (r["t"] < t) & (F.abs((d - t) - (r["d"] - r["t"])) <= DRIFT))
        best = F.array_max(F.transform(before, lambda r: F.struct(r["n"].alias("n"), (-r["first"]).alias("back"))))

        def put(b: Column) -> Column:
            first, n = F.coalesce(-b["back"], d), F.coalesce(b["n"], F.lit(0).cast("long")) + 1
            recent = F.concat(F.filter(s["recent"], lambda r: r["d"] >= d - width - DRIFT), F.array(F.struct(d.alias("d"), t.alias("t"), first.alias("first"), n.alias("n"))))
            ends = F.when(n >= need, F.concat(s["ends"], F.array(F.struct(first.alias("first"), d.alias("last"), n.alias("n"))))).otherwise(s["ends"])
            return F.struct(recent.alias("recent"), ends.alias("ends")).cast(shape)

        return let(best, put)

    none = F.struct(F.array().alias("recent"), F.array().alias("ends")).cast(shape)
    return F.aggregate(codes, none, step, lambda s: s["ends"])


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): doc_id, h, n_words of every row; and of each verified span doc_id, h, label, whole,
    first_word, last_word, score (share of the template's words)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("words"))
    counted = base.select("doc_id", "h", F.size("words").cast("long").alias("n_words"))
    index = templates(spark, phrases, notices).select("gram", "template", "t", "whole", F.col("run").alias("own_run"))
    # Rows of the same id and text give the same hits: a diagonal counts each place once.
    votes = (
        base.select("doc_id", "h", F.posexplode(grams(F.col("words"))).alias("d", "g"))
        .select("doc_id", "h", "d", F.col("g.hash").alias("gram"), F.col("g.run").alias("run"))
        .join(F.broadcast(index), "gram")
        .where("run = own_run")
        .select("doc_id", "h", "template", "whole", "t", (F.col("d") - F.col("t")).alias("diagonal"))
    )
    diagonals = Scratch(spark, "votes").save(votes.groupBy("doc_id", "h", "template", "whole", "diagonal").agg(F.collect_set("t").alias("places")))
    facts = F.broadcast(templates(spark, phrases, notices).select("template", "label", "n_grams", F.size("words").alias("n_template")).distinct())
    # Phrases: a diagonal with all grams. K-grams that overlap and agree in all places are the phrase's words.
    exact = (
        diagonals.where("whole").join(facts, "template").where(F.size("places") == F.col("n_grams"))
        .select("doc_id", "h", "label", F.lit(True).alias("whole"), F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("n_template") - 1).cast("long").alias("last_word"), F.lit(1.0).alias("score"))
    )
    # Notices: a region is a run of diagonals next to each other. A hit matches K words, so fewer votes than need / K
    # for different words of the notice are no span.
    need = F.greatest(F.ceil(F.col("n_template") * COVER), F.lit(LEAST_WORDS))
    document = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(document) > DRIFT, F.lit(True)).cast("int")
    hit = lambda t: (F.col("diagonal") + t).cast("long") * 65536 + t
    regions = (
        diagonals.where("not whole").withColumn("far", far).withColumn("region", F.sum("far").over(document))
        .groupBy("doc_id", "h", "template", "region")
        .agg(F.flatten(F.collect_list(F.transform("places", hit))).alias("hits"), F.flatten(F.collect_list("places")).alias("places"))
    )
    likely = regions.join(facts, "template").where(F.size(F.array_distinct("places")) * K >= need)
    codes = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.array(*(x + j * 65537 for j in range(K)))))))
    spans = (
        likely.select("doc_id", "h", "template", "label", "n_template", F.explode(chains(codes, F.col("n_template"), need)).alias("c"))
        .groupBy("doc_id", "h", "template", "label", "n_template", "c.first")
        .agg(F.max(F.struct("c.n", (-F.col("c.last")).alias("back"))).alias("best"))
        .select("doc_id", "h", "label", F.lit(False).alias("whole"), F.col("first").alias("first_word"), (-F.col("best.back")).alias("last_word"), (F.col("best.n") / F.col("n_template")).alias("score"))
    )
    return counted, exact.unionByName(spans)


def license_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base (places of phrases), first_word and last_word (starts of the first and last such place),
    base_labels, labels (with the notices'), score (largest share of a template that was found)."""
    counted, spans = license_scan(docs, **options)
    start = F.when(F.col("whole"), F.col("first_word"))
    found = spans.groupBy("doc_id", "h").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    # Null ids are told apart by the hash, so the join compares a stand-in together with whether it stands in.
    stand = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("i"), F.col("doc_id").isNull().alias("no_id"), "h"]
    return (
        counted.select("doc_id", "n_words", *stand)
        .join(found.select("n_base", "first_word", "last_word", "base_labels", "labels", "score", *stand), ["i", "no_id", "h"], "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
