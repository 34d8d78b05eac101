"""Licence scans by a trained paragraph classifier, in DataFrame and SQL functions only.

A paragraph is a line of a text, or a window of up to ``LINES`` lines without a blank one between them,
so that wrapped statements are read as one. A logistic regression over the one- and two-word runs of a
paragraph, with a class for each licence family and one for none, is fitted to wordings of the licence
templates and to half of all paragraphs without licence words. A paragraph is of the family with the highest
probability, or unknown: the probability must pass a threshold calibrated on the other half, which the fit
has not seen, and the paragraph must then hold most words and pairs of one of the family's templates. Of
windows that share a line the one that holds most of its template stays, then the shortest.

The features are the runs of the wordings. Paragraphs that hold the same of them are one row of the fit with
their number as weight, so all of them count, and most rows of a corpus fall together. The fit and the scores
are those of Spark's own ML library, which runs in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import combinations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vocarium.session import written

#: Family, and the statements by which texts say that they are under it.
TEMPLATES = {
    "mit": ("Released under the MIT License.",
            "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "This project is licensed under the Apache License 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "Released under the GNU General Public License, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.",
             "Released under the terms of the GNU Affero General Public License."),
    "bsd": ("Licensed under the BSD 3-Clause License.",
            "Released under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by": ("Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0": ("Dedicated to the public domain under CC0 1.0.",
            "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "proprietary": ("Copyright, all rights reserved.",
                    "All rights reserved. No part of this publication may be reproduced without prior written permission."),
}
FAMILIES = tuple(TEMPLATES)
#: Words before and after which a statement may stand in a wording used for the fit.
LEADS = ("", "note", "this file is", "the code below is", "unless stated otherwise")
TAILS = ("", "see the file for details", "version", "by the authors")
#: Weight of all background paragraphs together in the fit at most: how likely a statement is beforehand.
BACKGROUND = 2000
#: Features of the model; share of calibration paragraphs that may pass; words a template must share.
FEATURES = 4000
FALSE_SHARE = 0.0005
CONFIRMED = 0.6
#: Lines of the longest window: the longest template wrapped at four words a line.
LINES = 8
ITERATIONS = 40

WORD = r"[\p{L}\p{N}.\-]*[\p{L}\p{N}]"
#: Words of licence statements that no background paragraph may hold: they could be unlabelled statements.
WEAK = frozenset(("the", "of", "to", "in", "and", "a", "is", "that", "any", "this", "with", "or", "by", "under", "no", "for", "you", "it", "as",
                  "are", "be", "may", "can", "not", "all", "an", "at", "has", "v", "on", "use", "do", "if", "we", "from", "person", "work", "has"))
STATEMENT = r"(?i)\b(licen[sc]ed?|copyright|rights reserved|public domain|redistribution)\b"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def runs(tokens: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    return F.array_distinct(neighbours(tokens))


def neighbours(tokens: Column) -> Column:
    """Words and pairs of neighbouring words, repeats included."""
    following = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), following, lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, text)``: the lines of each text with a letter, numbered from 0."""
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("paragraph", "text"))
    return lines.filter(F.length(F.trim("text")) > 0)


def template_words(text: str) -> list[str]:
    """The words of a template, as ``words`` finds them."""
    return re.findall(r"[a-z0-9.\-]*[a-z0-9]", text.lower())


def strong_words() -> list[str]:
    """Words of the templates without those that any sentence may hold."""
    return sorted({w for texts in TEMPLATES.values() for text in texts for w in template_words(text)} - WEAK)


def least_strong() -> int:
    """How many different strong words a text must hold to share ``CONFIRMED`` of any template.

    A strong word that is missing takes its pairs along; whatever the other words are, a text with
    fewer strong words than this cannot be confirmed.
    """
    strong = set(strong_words())
    least = len(strong)
    for text in (text for texts in TEMPLATES.values() for text in texts):
        listed = template_words(text)
        wanted = {(w,) for w in listed} | set(zip(listed, listed[1:]))
        own = strong.intersection(listed)

        def share(held: Iterable[str], wanted=wanted, own=own) -> float:
            return sum(own.intersection(run) <= set(held) for run in wanted) / len(wanted)

        sizes = (k for k in range(least) if any(share(held) >= CONFIRMED for held in combinations(sorted(own), k)))
        least = next(sizes, least)
    return least


def windows(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, paragraph, size, text)``: lines, and windows of ``size`` lines from ``paragraph``.

    Lines and windows with fewer strong words than any template needs are left out, since they cannot
    be confirmed. A window of several lines starts and ends with a line that has a strong word, since
    others add nothing to a template's share, and spans no line without a letter or digit.
    """
    strong, least = F.array(*map(F.lit, strong_words())), least_strong()
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    # Null for a line without a letter or digit, otherwise its strong words.
    marked = split.withColumn("held", F.transform("lines", lambda x: F.when(
        x.rlike(r"[\p{L}\p{N}]"), F.array_intersect(words(x), strong))))

    def starts(held: Column, i: Column) -> Column:
        ahead = F.slice("held", i + 1, LINES)

        def fits(n: Column) -> Column:
            own = F.slice(ahead, 1, n)
            return (F.size(F.get(ahead, n - 1)) > 0) & F.forall(own, lambda x: x.isNotNull()) & (
                F.size(F.array_distinct(F.flatten(own))) >= least)

        sizes = F.when(F.size(held) > 0, F.filter(F.sequence(F.lit(1), F.lit(LINES)), fits)).otherwise(F.array().cast("array<int>"))
        text = lambda n: F.array_join(F.slice("lines", i + 1, n), "\n")
        return F.transform(sizes, lambda n: F.struct(i.alias("paragraph"), n.alias("size"), text(n).alias("text")))

    # The text is cut before the rows are made, so that no row carries all lines of its document.
    return marked.select("row", "doc_id", F.explode(F.flatten(F.transform("held", starts))).alias("at")).select(
        "row", "doc_id", "at.paragraph", "at.size", "at.text")


def best_windows(found: DataFrame) -> DataFrame:
    """Of the confirmed windows of a row those that share no line with a better one."""
    ranked = F.array_sort(F.collect_list(F.struct(
        (-F.col("template_share")).alias("order"), "size", "paragraph", "doc_id", "family", "probability", "template_share")))
    apart = lambda a, b: (a["paragraph"] + a["size"] <= b["paragraph"]) | (b["paragraph"] + b["size"] <= a["paragraph"])
    rows = found.groupBy("row").agg(ranked.alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda held, x: F.when(
        F.forall(held, lambda y: apart(x, y)), F.concat(held, F.array(x))).otherwise(held))
    return rows.select(F.explode(kept).alias("w")).select("w.*")


def literal_rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A table of constants that is part of the plan."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def wordings(spark: SparkSession) -> DataFrame:
    """``(text, label)``: every template in every frame; labels are places in ``FAMILIES``, from 1."""
    frames = literal_rows(spark, [(lead, tail) for lead in LEADS for tail in TAILS], ("lead", "tail"))
    whole = F.trim(F.concat_ws(" ", "lead", "text", "tail"))
    return templates(spark).withColumn("frames", F.lit(0)).join(frames, F.col("frames") == 0).select(
        whole.alias("text"), F.col("label"))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(text, float(i + 1), family) for i, family in enumerate(FAMILIES) for text in TEMPLATES[family]]
    return literal_rows(spark, rows, ("text", "label", "family"))


def background(docs: DataFrame, features: list[str]) -> DataFrame:
    """``(half, runs, n)``: how many of all paragraphs without licence words hold exactly these features, in each half.

    Equal paragraphs are in the same half. Those that hold most of a template are statements and left out.
    """
    plain = paragraphs(docs).filter(~F.col("text").rlike(STATEMENT)).select(
        F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"), words(F.col("text")).alias("tokens"))
    known = lambda run: run.isin(features)
    counted = plain.select("half", F.array_sort(F.array_distinct(F.filter(neighbours(F.col("tokens")), known))).alias("runs")).groupBy(
        "half", "runs").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(template_runs(docs.sparkSession).agg(F.flatten(F.collect_list("templates")).alias("templates")))).filter(
        template_share() < CONFIRMED).drop("templates")


def template_runs(spark: SparkSession) -> DataFrame:
    """``(label, family, templates)``: the runs of each template of a family; constants of this module."""
    own = templates(spark).select("label", "family", runs(words(F.col("text"))).alias("template"))
    return own.groupBy("label", "family").agg(F.collect_list("template").alias("templates"))


def template_share() -> Column:
    """Largest share of the runs of one of ``templates`` that ``runs`` hold."""
    return F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("runs"))) / F.size(t)))


class Scanner:
    """The fitted classifier: features, weights and the threshold of the unknown class."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        listed = written(wordings(spark).select("label", runs(words(F.col("text"))).alias("runs")), "wordings")
        self.features = CountVectorizer(inputCol="runs", outputCol="features", vocabSize=FEATURES, binary=True).fit(listed)
        found = written(background(docs, self.features.vocabulary), "background")
        total = found.filter("half = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
        weight = F.col("n") * min(1.0, BACKGROUND / max(total, 1))
        rows = listed.withColumn("weight", F.lit(1.0)).unionByName(
            found.filter("half = 0").select(F.lit(0.0).alias("label"), "runs", weight.alias("weight")))
        self.model = LogisticRegression(maxIter=ITERATIONS, regParam=0.002, elasticNetParam=0.2, family="multinomial", weightCol="weight").fit(
            self.features.transform(rows).select("features", "label", "weight"))
        # Only the part of the probabilities between the bounds of the threshold matters, so few values are told apart.
        bounded = F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.col("probability")))
        passed = self.scored(found.filter("half = 1")).agg(F.percentile(bounded, 1 - FALSE_SHARE, F.col("n")).alias("p")).first()["p"]
        self.threshold = passed or 0.5

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the best family's ``label`` and its ``probability``, by their ``runs``."""
        marked = self.model.transform(self.features.transform(rows))
        families = F.slice(vector_to_array(F.col("probability")), 2, len(FAMILIES))
        return (
            marked.withColumn("chances", families).drop("features", "rawPrediction", "prediction", "probability")
            .withColumn("probability", F.array_max("chances"))
            .withColumn("label", F.array_position("chances", F.col("probability")).cast("double")).drop("chances"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, family, probability, template_share)`` for each paragraph under a licence.

    ``paragraph`` is the number of its first line. All lines of all whole texts and windows of lines are
    scored that hold as many strong words as the least that any template asks for. Null and blank texts have none; equal paragraphs and
    repeated rows are rows of their own; ids may be null; other columns are ignored. The model is
    fitted to the templates and to all paragraphs without licence words; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if not docs.limit(1).count():
        return spark.createDataFrame([], "doc_id long, paragraph int, family string, probability double, template_share double")
    scanner = Scanner(docs)
    found = scanner.scored(windows(docs).withColumn("runs", runs(words(F.col("text"))))).filter(F.col("probability") >= scanner.threshold)
    confirmed = found.join(F.broadcast(template_runs(spark)), "label").withColumn("template_share", template_share())
    return best_windows(confirmed.filter(F.col("template_share") >= CONFIRMED)).select(
        "doc_id", "paragraph", "family", "probability", "template_share")
