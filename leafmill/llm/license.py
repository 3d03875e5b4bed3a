"""License scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs (lines up to a blank one) are cut into windows of words, and so is each of their lines:
a wrapped notice is in a window of its paragraph, and two short notices on lines of their
own are apart in those of the lines.  A sparse logistic regression over hashed word n-grams
(1 to 3 words, present or not) gives each window a licence family or none; it is trained on
the templates in varied surroundings and on lines of the corpus (``NEGATIVES`` at most).
The probability of any family that a window needs is calibrated on lines kept out of training.  A
prediction holds if enough of a template's word triples are in the window.

A window can be confirmed only if it has one of the ``ANCHORS``: fewer of any template's
triples than must be found lack them (checked on import).  So only windows that hold one are
classified; that loses nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable

#: Customary notices by family.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3 Clause License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
ANCHORS = ("license", "licence", "licensed", "licenced", "permission", "redistribution", "file", "forms", "source", "clause", "charge", "person", "copy", "software")
NONE = "none"

WINDOW, STRIDE = 48, 24
FEATURES = 1 << 14
NEGATIVES, CONTEXTS = 2000, 24
MIN_PROBABILITY, FALSE_RATE = 0.5, 0.002
#: Share of a template's word triples that must be in the window.
CONTAINMENT = 0.75


def _tokens(line: Column) -> Column:
    """Lower-cased runs of letters, digits, and dots and hyphens inside them."""
    plain = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}.-]+", " ")
    plain = F.regexp_replace(plain, r"(?<![\p{L}\p{N}])[.-]+|[.-]+(?![\p{L}\p{N}])", " ")
    return F.array_remove(F.split(plain, " ", -1), "")


def _grams(w: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
    join = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
    return F.when(F.size(w) >= n, F.transform(at, join)).otherwise(F.array().cast("array<string>"))


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds ``grams`` (1 to 3 words) and ``triples`` to rows with ``w``."""
    df = df.withColumn("triples", F.array_distinct(_grams(F.col("w"), 3)))
    return df.withColumn("grams", F.concat("w", _grams(F.col("w"), 2), "triples"))


def templates(spark) -> DataFrame:  # noqa: ANN001
    rows = spark.createDataFrame(list(enumerate(TEMPLATES)), "template int, t struct<family:string,text:string>")
    return _with_grams(rows.select("template", "t.family", _tokens(F.col("t.text")).alias("w")))


def anchored(line: Column) -> Column:
    return F.lower(line).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(ANCHORS) + r")(?![\p{L}\p{N}])")


def _check_anchors() -> None:
    """Fewer than CONTAINMENT of each template's triples are without an anchor."""
    import re

    for _, text in TEMPLATES:
        w = re.sub(r"(?<!\w)[.-]+|[.-]+(?!\w)", " ", re.sub(r"[^\w.-]+", " ", text.lower())).split()
        triples = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        if sum(not set(t) & set(ANCHORS) for t in triples) >= CONTAINMENT * len(triples):
            raise AssertionError(f"no anchor in {text!r}")


_check_anchors()


def _lines(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    return d.where(F.col("line").rlike(r"\p{L}"))


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first_word, w, lines): windows with an anchor, and the line number of each word; first_word counts in the paragraph."""
    d = docs.where(anchored(F.col("text"))).select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("l"))
    blank = F.transform("l", lambda x: ~x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("blank", blank).withColumn("i", F.sequence(F.lit(0), F.size("l") - 1))
    edge = lambda step: F.filter("i", lambda i: ~F.get("blank", i) & F.coalesce(F.get("blank", i + step), F.lit(True)))
    d = d.withColumn("from", edge(-1)).withColumn("to", edge(1))
    parts = F.zip_with("from", "to", lambda a, b: F.struct(a.alias("line"), F.slice("l", a + 1, b - a + 1).alias("l")))
    parts = F.filter(parts, lambda x: F.exists(x["l"], anchored))
    d = d.select("doc_id", "th", F.explode(parts).alias("part")).select("doc_id", "th", "part.line", F.transform("part.l", _tokens).alias("by"))
    each = F.transform("by", lambda x, i: F.array_repeat(F.col("line") + i, F.size(x)))
    d = d.select("doc_id", "th", "line", "by", F.flatten("by").alias("all"), F.flatten(each).alias("at")).where("size(all) > 0")
    starts = lambda n: F.sequence(F.lit(0), F.greatest(n - (WINDOW - STRIDE), F.lit(0)), F.lit(STRIDE))
    cut = lambda first, n: F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"))
    whole = F.transform(starts(F.size("all")), lambda i: cut(i, F.least(F.lit(WINDOW), F.size("all") - i)))
    # the place of each line's first word, and its words
    first = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda j: (j == 0) | (F.get("at", j) != F.get("at", j - 1)))
    d = d.withColumn("first", first).withColumn("next", F.concat(F.slice("first", 2, F.size("all")), F.array(F.size("all"))))
    runs = F.zip_with("first", "next", lambda a, b: F.struct(a.alias("first"), (b - a).alias("n")))
    own = F.flatten(F.transform(runs, lambda x: F.transform(starts(x["n"]), lambda i: cut(x["first"] + i, F.least(F.lit(WINDOW), x["n"] - i)))))
    words = lambda c, x: F.slice(c, x["first"] + 1, x["n"])
    found = F.filter(F.array_distinct(F.concat(whole, own)), lambda x: F.arrays_overlap(words("all", x), F.array(*[F.lit(a) for a in ANCHORS])))
    found = F.transform(found, lambda x: F.struct(x["first"].alias("first_word"), words("all", x).alias("w"), words("at", x).alias("lines")))
    return d.select("doc_id", "th", F.explode(found).alias("x")).select("doc_id", "th", "x.*")


def training_rows(lines: DataFrame) -> DataFrame:
    """(family, w, held): templates among words of corpus lines, and corpus lines as they are.

    Lines are drawn by hash, about evenly from the whole corpus: those of the smallest hashes, NEGATIVES of them at most.
    """
    spark = lines.sparkSession
    n = max(1, lines.count())
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", "line_no"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = lines.where(draw < F.lit(min(1.0, NEGATIVES / n))).orderBy(draw, F.xxhash64("line")).limit(NEGATIVES)
    sample = durable(sample.select(F.slice(_tokens(F.col("line")), 1, WINDOW).alias("w"), F.xxhash64("line").alias("h")).where("size(w) > 0"))
    known = templates(spark)
    clean = sample.withColumn("triples", _grams(F.col("w"), 3))
    listed = known.agg(F.array_distinct(F.flatten(F.collect_list("triples")))).first()[0]  # of a dozen templates
    clean = clean.where(~F.arrays_overlap("triples", F.array(*[F.lit(x) for x in listed]))).select("w", "h")
    negatives = clean.select(F.lit(NONE).alias("family"), "w", (F.pmod("h", F.lit(3)) == 0).alias("held"))
    # each template alone, and CONTEXTS times between words of some line
    slots = known.select("family", "w", F.explode(F.sequence(F.lit(0), F.lit(CONTEXTS))).alias("k"), "template")
    lines_by = clean.withColumn("slot", F.pmod("h", F.lit(len(TEMPLATES) * CONTEXTS))).groupBy("slot").agg(F.min_by("w", "h").alias("cw"))
    slots = slots.withColumn("slot", (F.col("template") * CONTEXTS + F.col("k") - 1).cast("long")).withColumn("slot", F.when(F.col("k") > 0, F.col("slot")))
    varied = slots.join(lines_by, "slot", "left").withColumn("cw", F.coalesce("cw", F.array().cast("array<string>")))
    cut = F.pmod(F.xxhash64("slot"), F.lit(8)).cast("int")
    around = F.concat(F.slice("cw", 1, cut), "w", F.slice("cw", cut + 1, F.lit(8)))
    return negatives.unionByName(varied.select("family", around.alias("w"), F.lit(False).alias("held")))


class Classifier:
    def __init__(self, lines: DataFrame) -> None:
        rows = _with_grams(training_rows(lines))
        self.families = sorted({f for f, _ in TEMPLATES})
        labels = [*self.families, NONE]
        label = reduce(lambda c, x: c.when(F.col("family") == x[1], F.lit(float(x[0]))), enumerate(labels), F.when(F.lit(False), F.lit(0.0)))
        self.hash = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
        rows = durable(self.hash.transform(rows.withColumn("label", label)).select("label", "features", "held"))
        each = rows.groupBy("label").agg(F.count("*").alias("each"))
        fit = rows.where("not held").join(broadcast_if_small(durable(each)), "label").withColumn("weight", F.lit(1.0) / F.sqrt("each"))
        self.model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, weightCol="weight").fit(fit)
        # a line without a licence passes with a chance of FALSE_RATE at most
        held = self.probabilities(rows.where("held"), features=True).agg(F.percentile("best", 1 - FALSE_RATE)).first()[0]
        self.least = max(MIN_PROBABILITY, held or 0.0)

    def probabilities(self, df: DataFrame, features: bool = False) -> DataFrame:
        """Adds ``family`` (the likeliest one but none) and ``best``, the probability that it is any family: near ones share it."""
        out = self.model.transform(df if features else self.hash.transform(df))
        p = F.slice(vector_to_array("probability"), 1, len(self.families))
        out = out.withColumn("p", p).withColumn("best", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
        names = F.array(*[F.lit(x) for x in self.families])
        return out.withColumn("family", F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))).drop("features", "rawPrediction", "probability", "prediction", "p")


def scan(docs: DataFrame) -> DataFrame:
    """One row per confirmed family and line: doc_id, th, line_no, first_word, family, probability, containment.

    A notice is on the lines of the closest run of enough of its triples, and of the others just around it.
    The window with the highest containment stands for its line and family; of equal ones the first.  Families whose
    notices hold the same triples are told apart by the classifier.  Null and empty texts have no lines; very long texts
    and lines are cut into windows like any other.  Repeated rows are found once.  An empty table gives no rows.
    """
    model = Classifier(_lines(docs))
    said = model.probabilities(_with_grams(_windows(docs))).where(F.col("best") >= model.least)
    known = templates(docs.sparkSession).select("family", F.col("triples").alias("known"))
    both = said.join(F.broadcast(known), "family")  # as many rows as TEMPLATES has
    both = both.withColumn("containment", F.size(F.array_intersect("known", "triples")) / F.size("known")).where(F.col("containment") >= CONTAINMENT)
    every = _grams(F.col("w"), 3)
    both = both.withColumn("p", F.filter(F.transform(every, lambda x, i: F.when(F.array_contains("known", x), i)), lambda i: i.isNotNull()))
    both = both.withColumn("m", F.ceil(F.size("known") * CONTAINMENT).cast("int") - 1)
    runs = F.transform(F.sequence(F.lit(0), F.size("p") - 1 - F.col("m")), lambda i: F.struct((F.get("p", i + F.col("m")) - F.get("p", i)).alias("long"), F.get("p", i).alias("from")))
    both = both.withColumn("run", F.array_min(runs))
    rest = F.size("known") - F.col("m") - 1
    start = F.array_min(F.filter("p", lambda i: i >= F.col("run.from") - rest))
    end = F.array_max(F.filter("p", lambda i: i <= F.col("run.from") + F.col("run.long") + rest))
    line_no = F.sequence(F.get("lines", start), F.get("lines", end + 2))
    both = both.withColumn("line_no", F.explode(line_no))
    top = F.max(F.struct("containment", (-F.col("first_word")).alias("at"), "best"))
    found = both.groupBy("doc_id", "th", "line_no", "family").agg(top.alias("t"))
    return found.select("doc_id", "th", "line_no", (-F.col("t.at")).alias("first_word"), "family", F.col("t.best").alias("probability"), F.col("t.containment").alias("containment"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (with a letter), n_license_lines and families (sorted, joined by commas; empty: none)."""
    d = docs.select("doc_id", "text")
    found = durable(scan(d))
    by = found.groupBy("doc_id", "th").agg(F.count_distinct("line_no").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("f"))
    by = by.select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), "n", "f")
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"\p{L}"))).cast("long")
    rows = d.select("doc_id", F.xxhash64("text").alias("th"), lines.alias("n_lines"))
    out = rows.join(by, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__h")), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("f", F.lit("")).alias("families"))
