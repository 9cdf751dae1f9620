"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates; DataFrame functions only.

Paragraphs are lines, and blocks of several lines between lines without letters or digits, as statements are often wrapped.
A sparse logistic regression over word 1- to 3-grams scores every paragraph for each licence family
and for the class of anything else; its scores are calibrated on held-out examples of both sides, and what stays below the
threshold of its family is unknown. The most probable family alone is then confirmed: where the paragraph contains most word
pairs of one of its templates, or one of its names behind a word that licenses, as SPDX identifier or alone. What is predicted
but not confirmed is unknown, whatever other families' names it has.

Anchors are words chosen so that a paragraph without any of them shares too few word pairs with every template and has no
name to be confirmed. Texts and paragraphs without an anchor are therefore set aside first, which loses nothing.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, unstage
from .texts import release_shuffles

UNKNOWN = "unknown"
CONTAINED = 0.8
OTHERS = 2000  # most paragraphs of the corpus that a fit sees as anything else
GRAMS = 8192  # most features

# Short public licence statements by family
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0", "Distributed under the Apache 2.0 license.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Distributed under the MIT license.",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
            "SPDX-License-Identifier: MIT"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "Distributed under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2 or later.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "LGPL": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL version 2.1 or later.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
             "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Licensed under the ISC license.", "Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "SPDX-License-Identifier: ISC"],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
                "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
}
# Names of families, in words as ``words`` makes them, and what has to stand before them
NAMES = {
    "Apache-2.0": r"apache(?: software)? licen[sc]e(?! (?:version )?v?1)|apache (?:version )?v?2(?:_0)?", "MIT": r"mit(?: x11| expat)? licen[sc]e",
    "BSD": r"bsd(?: (?:\d|style|like|clause|new|revised|simplified))* licen[sc]e", "GPL": r"gnu general public licen[sc]e|gpl(?:v?\d\S*)?",
    "LGPL": r"gnu (?:lesser|library) general public licen[sc]e|lgpl(?:v?\d\S*)?", "AGPL": r"gnu affero general public licen[sc]e|agpl(?:v?\d\S*)?",
    "MPL-2.0": r"mozilla public licen[sc]e(?! (?:version |v )?v?1)|mpl (?:v )?v?2_0", "ISC": r"isc licen[sc]e", "CC0-1.0": r"cc0|creative commons zero",
    "Unlicense": r"unlicen[sc]e", "CC-BY": r"creative commons attribution(?: \d\S*)?(?: international| generic| unported| licen[sc]e)|cc by(?= v?\d| licen[sc]e|$)",
    "CC-BY-SA": r"creative commons attribution share ?alike|cc by sa",
    "CC-BY-NC": r"creative commons attribution non ?commercial(?! (?:share|no))|cc by nc(?! (?:sa|nd))"}
BARE_NAMES = {"MIT": "mit", "BSD": "bsd", "ISC": "isc"}  # that need more care, as they are words elsewhere
LICENSING = r"under|licensed|licen[sc]e identifier|governed by|subject to|terms of|released|distributed|available"
# What every text with a name has; of the last ones, behind "under" or "under the"
NAMED, PAIRED, UNDER = ["licens", "licenc", "apache", "gpl", "cc0", "cc by", "cc-by", "mpl"], ["creative", "commons"], ["mit", "bsd", "isc"]
# Lines that speak of licences and give none
SPOKEN = ["a license plate", "this text speaks of a license", "you need a license to drive", "the license plate of the car", "a fishing license costs more",
          "a license fee must be paid", "with permission of the author", "the software is free of charge", "this version of the software",
          "the general public is free to use it", "the foundation was published by a person", "a copy of the documentation", "creative work in common form",
          "the conditions of the source are met", "the driver lost his license", "public domain name of the project", "poetic license"]
# Words that templates share with any text
COMMON = {"a", "an", "and", "any", "are", "as", "by", "can", "except", "following", "form", "forms", "free", "in", "is", "it", "may", "met",
          "not", "of", "or", "person", "provided", "that", "the", "this", "to", "under", "use", "with", "without", "work", "you"}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a version's dot stays inside its number."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?<=\d)\.(?=\d)", "_"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def grams(of: Column, n: int) -> Column:
    """All runs of ``n`` words."""
    last = F.size(of) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(
        F.slice(of, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def pairs_of(of: Column) -> Column:
    return F.array_distinct(grams(of, 2))


def contained(template: Column, pairs: Column) -> Column:
    """The share of a template's word pairs among ``pairs``."""
    return F.size(F.array_intersect(template, pairs)) / F.size(template)


def all_grams(of: Column) -> Column:
    return F.array_distinct(F.concat(grams(of, 1), grams(of, 2), grams(of, 3)))


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of plain values, by SQL functions alone."""
    names = [column.split(" ")[0] for column in schema.split(", ")]
    fields = ", ".join(column.replace(" ", ":", 1) for column in schema.split(", "))
    written = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(written), f"array<struct<{fields}>>")))


def templates(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """(family, template (number), words, pairs) of every template, and the anchors of all."""
    rows = [(family, i, text) for family, own in (texts or TEMPLATES).items() for i, text in enumerate(own)]
    table = local(spark, rows, "family string, template int, text string")
    table = table.withColumn("words", words(F.col("text"))).withColumn("pairs", pairs_of(F.col("words"))).drop("text")
    found: list[str] = []
    for _, _, own, pairs in table.orderBy("family", "template").collect():
        # words in use already first, then the longest; a version's parts may be written apart, so no word with a number
        for word in sorted({w for w in own if w not in COMMON and w.isalpha()}, key=lambda w: (w not in found, -len(w), w)):
            if sum(not set(pair.split(" ")) & set(found) for pair in pairs) < CONTAINED * len(pairs):
                break
            found = found if word in found else [*found, word]
        if sum(not set(pair.split(" ")) & set(found) for pair in pairs) >= CONTAINED * len(pairs):
            raise ValueError(f"a template could be confirmed without any of its words: {own}")
    return table, sorted(found)


@dataclass
class LicenceModel:
    """Weights (gram, family, weight), one bias and one threshold per family; all bounded by the template list."""

    weights: DataFrame
    families: list[str]
    biases: list[float]
    thresholds: list[float]
    templates: DataFrame
    anchors: list[str]


def has_any(text: Column, anchors: list[str]) -> Column:
    """Whether the text, lower-cased once, contains one of the anchors or what every name needs."""
    def told(lowered):
        has = lambda word: F.contains(lowered, F.lit(word))
        found = has(PAIRED[0]) & has(PAIRED[1])
        for word in [*anchors, *NAMED]:
            found = found | has(word)
        short = has(UNDER[0]) | has(UNDER[1]) | has(UNDER[2])
        behind = rf"under[^\p{{L}}\p{{N}}]+(?:the[^\p{{L}}\p{{N}}]+)?(?:{'|'.join(UNDER)})\b"
        return found | (has("under") & short & F.rlike(lowered, F.lit(behind)))
    return F.exists(F.array(F.lower(text)), told)


def named(body: Column, family: str) -> Column:
    """Whether words joined by blanks license by one of the family's names, or consist of it and its version."""
    own = NAMES.get(family)
    if own is None:
        return F.lit(False)
    short = f"|(?:under|licen[sc]e identifier)(?: the)? {BARE_NAMES[family]}" if family in BARE_NAMES else ""
    return F.rlike(body, F.lit(rf"(?:^| )(?:(?:{LICENSING})(?: \S+){{0,12}}? (?:{own}){short})(?: |$)"
                               rf"|^(?:the )?(?:{own})(?: (?:version|v?\d\S*|mit|only|or|later|international|generic|unported))*$"))


def newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n")))


def lines(text: Column, anchors: list[str]) -> Column:
    """(paragraph, last, body) of every line that has an anchor; ``last`` is null."""
    made = F.transform(F.split(text, "\n"), lambda b, i: F.struct(i.alias("paragraph"), F.lit(None).cast("int").alias("last"), b.alias("body")))
    return F.filter(made, lambda x: has_any(x["body"], anchors))


def blocks(text: Column, anchors: list[str]) -> Column:
    """paragraph (number of the first line), last (of the last one) and body of every block of several lines that has an anchor.

    Line breaks are blanks; comment marks are no words.
    """
    def block(parts, part, i):
        first = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + newlines(p)) + newlines(
            F.regexp_extract(part, r"^[^\p{L}\p{N}]*", 0))
        body = F.regexp_replace(part, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        return F.struct(first.alias("paragraph"), (first + newlines(body)).alias("last"), F.translate(body, "\r\n", "  ").alias("body"))

    def made(parts):
        told = F.transform(parts, lambda part, i: F.when(has_any(part, anchors), block(parts, part, i)))
        return F.filter(told, lambda x: x["last"] > x["paragraph"])

    return F.transform(F.array(F.split(text, r"(?<=\n)(?=[^\p{L}\p{N}\n]*\n)")), made)[0]


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, paragraph (number), start (code point) and body of every line of ``text`` that is not blank."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return df.select(key, F.posexplode(lines).alias("paragraph", "body")).where(F.trim("body") != "")


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", others: int = OTHERS,
        texts: dict[str, list[str]] | None = None) -> LicenceModel:
    """Model from the templates, shortened copies of them, and at most ``others`` lines of the corpus as anything else.

    Those lines are the ones with the smallest hashes among the rows whose key's hash falls in a share that the row count
    sets; lines that some family's templates or names would confirm are left out. At most ``GRAMS`` word n-grams, the most
    frequent ones of the examples, are features. An empty table gives a model of the templates alone.
    """
    spark = df.sparkSession
    # written tables keep the plans of the many jobs short, which the driver keeps with all their values
    known, anchors = templates(spark, texts)
    known = stage(known, "templates")
    families = sorted(texts or TEMPLATES)
    # examples: every template, and copies without their first or last words and with words around them
    n = F.size("words")
    cut = F.explode(F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("less"), F.lit(pad).alias("pad"))
                              for a in (0, 1, 2) for b in (0, 1, 2) for pad in ("", "copyright notice", "see"))))
    examples = known.select("family", "words", cut.alias("cut")).where(n - F.col("cut.from") - F.col("cut.less") >= F.greatest(F.lit(2), n * 0.7))
    body = F.slice("words", F.col("cut.from") + 1, n - F.col("cut.from") - F.col("cut.less"))
    examples = examples.select("family", F.when(F.col("cut.pad") == "", body).otherwise(F.concat(F.split("cut.pad", " "), body)).alias("words"))
    plain = paragraphs(df.where(F.pmod(F.xxhash64(key), F.lit(max(1, df.count() // others))) == 0), key, text)
    plain = plain.orderBy(F.xxhash64("body"), key, "paragraph").limit(others).withColumn("words", words(F.col("body")))
    own = known.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "family", "template"), "pairs"))).alias("own"))
    plain = plain.join(F.broadcast(own)).withColumn("near", F.exists(F.map_values("own"), lambda t: contained(t, pairs_of(F.col("words"))) >= CONTAINED))
    written = F.array_join("words", " ")
    plain = plain.where(~F.col("near") & ~functools.reduce(lambda a, b: a | b, (named(written, family) for family in families)))
    spoken = [(UNKNOWN, ["the", word]) for word in sorted(COMMON)] + [(UNKNOWN, line.split(" ")) for line in SPOKEN]
    examples = (examples.unionByName(plain.select(F.lit(UNKNOWN).alias("family"), "words"))
                .unionByName(local(spark, spoken, "family string, words array<string>")))
    classes = [UNKNOWN, *families]
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double") - 1
    rows = stage(examples.coalesce(1).select(label.alias("label"), all_grams(F.col("words")).alias("grams"),
                           F.pmod(F.xxhash64("family", "words"), F.lit(5)).alias("fold")), "examples")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    weighed = rows.join(F.broadcast(counts), "label").withColumn("weight", 1.0 / F.col("n"))
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=GRAMS, binary=True)

    def trained(train):
        logistic = LogisticRegression(weightCol="weight", regParam=0.002, elasticNetParam=0.5, family="multinomial", maxIter=200, tol=1e-5, standardization=False)
        return Pipeline(stages=[vectors, logistic]).fit(train)

    # calibration: a family's threshold lies between the least probability of its held-out examples and the most that held-out
    # examples of anything else get, above chance
    tried = trained(weighed.where("fold <> 0")).transform(rows.where("fold = 0")).select("label", vector_to_array("probability").alias("p"))
    own = F.col("p")[F.col("label").cast("int")]
    least = {int(r[0]): r[1] for r in tried.where("label > 0").groupBy("label").agg(F.min(own)).collect()}
    most = tried.where("label = 0").agg(*(F.max(F.col("p")[i + 1]) for i in range(len(families)))).first()
    thresholds = [min(0.5, max(1.5 / len(classes), 0.5 * (least.get(i + 1, 1.0) + (most[i] or 0.0)))) for i in range(len(families))]
    release_shuffles(df)  # the jobs of the first fit leave much behind on the driver
    final = trained(weighed)
    counted, logistic = final.stages
    matrix = logistic.coefficientMatrix.toArray()
    weights = [(gram, classes[k], float(matrix[k, i])) for i, gram in enumerate(counted.vocabulary)
               for k in range(len(classes)) if abs(matrix[k, i]) > 1e-6]
    unstage(rows)
    release_shuffles(df)
    return LicenceModel(stage(local(spark, weights, "gram string, family string, weight double"), "weights"), families,
                        [float(b) for b in logistic.interceptVector.toArray()], thresholds, known, anchors)


def licence_scan(df: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per licence paragraph: ``key``, paragraph, family, probability, similarity, n_words.

    A paragraph's number is that of its line, or of its first line where it is a block of several. A block counts only where
    none of its lines gives the same family as well, and as unknown only where none of its lines gives any; lines that say less
    than their block, unknown ones or those with a name where the block has a template, give way to it.
    The most probable family counts where it is confirmed and reaches its calibrated threshold. The paragraph is ``unknown``
    where it is confirmed below the threshold, or unconfirmed but more probably a licence than anything else; what is neither
    is left out. Null and empty texts have no paragraphs. Rows that share a key are scanned each, and have equal numbers.
    """
    docs = df.where(has_any(F.col(text), model.anchors)).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_doc"))
    found = docs.select("_key", "_doc", F.inline(F.concat(lines(F.col("_text"), model.anchors), blocks(F.col("_text"), model.anchors))))
    found = found.withColumn("_row", F.monotonically_increasing_id()).withColumn("_words", words(F.col("body"))).drop("body")
    classes = [UNKNOWN, *model.families]
    table = model.weights.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("family", "weight"))).alias("_w"))
    scored = found.select("*", F.explode(all_grams(F.col("_words"))).alias("gram")).join(F.broadcast(table), "gram")
    sums = [F.sum(F.coalesce(F.element_at("_w", c), F.lit(0.0))).alias(f"_z{i}") for i, c in enumerate(classes)]
    scored = scored.groupBy("_key", "_doc", "paragraph", "last", "_row", "_words").agg(*sums)
    z = [F.col(f"_z{i}") + b for i, b in enumerate(model.biases)]
    top = F.greatest(*z)
    odds = functools.reduce(lambda a, b: a + b, (F.exp(x - top) for x in z))
    best = F.array_max(F.array(*(F.struct(z[i + 1].alias("z"), F.lit(-i).alias("place")) for i in range(len(model.families)))))
    judged = scored.select("_key", "_doc", "paragraph", "last", "_words", (F.exp(z[0] - top) / odds).alias("_plain"),
                           (F.exp(best["z"] - top) / odds).alias("probability"), (-best["place"]).alias("_place"))
    own = model.templates.groupBy("family").agg(F.collect_list("pairs").alias("_own"))
    judged = judged.withColumn("_family", F.array(*map(F.lit, model.families))[F.col("_place")]).join(
        F.broadcast(own.withColumnRenamed("family", "_family")), "_family")
    written = F.array_join("_words", " ")
    judged = judged.withColumn("similarity", F.transform(F.array(pairs_of(F.col("_words"))), lambda own_pairs: F.array_max(
        F.transform("_own", lambda t: contained(t, own_pairs))))[0])
    by_name = F.coalesce(*(F.when(F.col("_family") == family, named(written, family)) for family in model.families))
    judged = judged.withColumn("_confirmed", (F.col("similarity") >= CONTAINED) | by_name)
    sure = F.col("probability") >= F.array(*map(F.lit, model.thresholds))[F.col("_place")]
    judged = judged.where(F.col("_confirmed") | (F.col("_plain") < 0.5))
    family = F.when(F.col("_confirmed") & sure, F.col("_family")).otherwise(F.lit(UNKNOWN))
    made = judged.select("_key", "_doc", F.struct("paragraph", family.alias("family"), F.round("probability", 6).alias("probability"),
                         F.round("similarity", 6).alias("similarity"), F.size("_words").alias("n_words"), "last").alias("_p"))
    made = made.groupBy("_key", "_doc").agg(F.collect_list("_p").alias("_all"))

    def covers(line, block):
        return line["last"].isNull() & block["last"].isNotNull() & line["paragraph"].between(block["paragraph"], block["last"])

    def less(line, block):
        return (block["family"] != UNKNOWN) & ((line["family"] == UNKNOWN) | ((line["family"] == block["family"])
                & (line["similarity"] < CONTAINED) & (block["similarity"] >= CONTAINED)))

    def told(block):
        return F.exists("_all", lambda x: covers(x, block) & ~less(x, block) & ((x["family"] == block["family"]) | (block["family"] == UNKNOWN)))

    made = made.withColumn("_all", F.filter("_all", lambda p: p["last"].isNull() | ~told(p)))
    whole = made.select(F.col("_key").alias(key), F.inline(F.filter("_all", lambda p: ~F.exists("_all", lambda x: covers(p, x) & less(p, x)))))
    return whole.drop("last")
