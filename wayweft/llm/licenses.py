"""Licence statements in documents: a trained paragraph classifier, confirmed by template comparison.

A multinomial logistic regression over hashed word n-grams of the templates tells a paragraph's
licence family or the unknown class. It learns from stretches of the templates and from all paragraphs
without template phrases, counted by the features they hit. A threshold, set on the half of them kept
out of training, calibrates the unknown class, and a prediction counts only if the paragraph shares enough word
trigrams with a template of its family; one without trigrams has to be a template word by word. Scoring is one
expression over each paragraph that can be confirmed at all; the pass that counts sets these aside.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayweft.llm.shared import LOWER, UPPER, WORD, text_words
from wayweft.session import materialise

SLOTS = 1 << 16
#: All paragraphs without template phrases weigh at most as much as so many paragraphs with one.
UNKNOWN_WEIGHT = 1000
#: The threshold is found to one part of this many.
STEPS = 10_000
ROWS_A_TASK = 50_000
#: Share of unknown paragraphs that may pass the threshold.
PASS = 0.005
COVERED = 0.5
UNKNOWN = "unknown"

# Characteristic wording of licences, as their texts and the usual notices have it.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
}
# Names and identifiers that stand for a licence on a line of their own.
SHORT = {
    "mit": ["MIT License", "SPDX-License-Identifier: MIT"],
    "apache-2.0": ["Apache License", "SPDX-License-Identifier: Apache-2.0"],
    "gpl": [f"SPDX-License-Identifier: GPL-{v}" for v in ("2.0", "2.0-only", "2.0-or-later", "3.0", "3.0-only", "3.0-or-later")],
    "lgpl": [f"SPDX-License-Identifier: LGPL-{v}" for v in ("2.1", "2.1-only", "2.1-or-later", "3.0", "3.0-only", "3.0-or-later")],
    "agpl": [f"SPDX-License-Identifier: AGPL-3.0{v}" for v in ("", "-only", "-or-later")],
    "mpl-2.0": ["SPDX-License-Identifier: MPL-2.0"],
    "bsd": ["BSD License", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["SPDX-License-Identifier: CC-BY-4.0", "CC BY"],
    "cc-by-sa": ["SPDX-License-Identifier: CC-BY-SA-4.0", "CC BY-SA"],
    "cc-by-nc": ["SPDX-License-Identifier: CC-BY-NC-4.0", "CC BY-NC"],
    "cc0": ["SPDX-License-Identifier: CC0-1.0"],
}
FAMILIES = sorted(TEMPLATES)


def paragraph_words(text: Column) -> Column:
    """A-Z lower-cased words without punctuation at their ends."""
    bare = F.transform(text_words(F.translate(text, UPPER, LOWER)), lambda w: F.btrim(w, F.lit(".,;:!?\"'()[]{}<>*#")))
    return F.array_remove(bare, "")


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _slot(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(SLOTS)).cast("int")


def _slots(w: Column) -> Column:
    """The distinct slots of the words and word pairs of an array."""
    pairs = F.transform(w, lambda x, i: _slot(x, F.get(w, i + 1)))
    return F.array_distinct(F.concat(F.transform(w, lambda x: _slot(x)), pairs))


def _trigrams(w: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(w, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2))), lambda t: t.isNotNull()))


def _said(w: Column) -> Column:
    """Words without those that are marks only."""
    return F.filter(w, lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _template_rows(spark) -> DataFrame:
    rows = [(family, text) for family in FAMILIES for text in [*TEMPLATES[family], *SHORT[family]]]
    return spark.createDataFrame(rows, "family string, text string").withColumn("w", paragraph_words(F.col("text")))


@dataclass
class Model:
    """Weights by slot (one stretch a family), intercepts, the threshold, the templates' trigrams and those without any."""

    weights: list[float]
    intercepts: list[float]
    classes: list[str]
    active: list[int]
    threshold: float
    trigrams: dict[str, list[list[str]]]
    short: dict[str, list[str]]


def paragraphs(docs: DataFrame, signs: list[list[str]] | None = None) -> DataFrame:
    """(doc_id, paragraph, line, w) for every non-blank line of every text; with ``signs``, for those that have all words of one of these in any case."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "line"))
    if signs is None:
        lines = lines.where(F.col("line").rlike(WORD))
    else:
        signed = lambda low: reduce(Column.__or__, [reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in words]) for words in signs])
        lines = lines.where(_bind(F.lower("line"), signed))
    return lines.withColumn("w", paragraph_words(F.col("line")))


def _signs(model: Model) -> list[list[str]]:
    """Lists of words; every trigram and every short statement of the model has all words of one, so no other paragraph is ever confirmed."""
    words = [t.split(" ") for per in model.trigrams.values() for trigrams in per for t in trigrams] + [t.split(" ") for per in model.short.values() for t in per]
    chosen: dict[str, list[str]] = {}
    for text in sorted(words, key=lambda ws: -max(map(len, ws))):
        longest = max(text, key=lambda w: (len(w), w))
        # Short words occur in most paragraphs; these have to meet.
        if not any(w in chosen for w in text):
            chosen.update({longest: [longest]} if len(longest) > 4 else {" ".join(text): sorted(set(text), key=lambda w: (-len(w), w))})
    return list(chosen.values())


def fit(docs: DataFrame) -> Model:
    """The classifier from the templates and all paragraphs of ``docs``."""
    return _learnt(docs, False)[0]


def _learnt(docs: DataFrame, keep: bool) -> tuple[Model, DataFrame]:
    """The classifier, and with ``keep`` all paragraphs (doc_id, paragraph, line, hits) that a scan could confirm.

    One pass counts the paragraphs without template phrases by the features they hit, which is all the
    regression sees of them. Half of them teach the unknown class, by their counts; the others calibrate it.
    What shares a trigram with a template or is a short statement is kept on the way, so no scan reads the texts again.
    """
    spark = docs.sparkSession
    templates = _template_rows(spark).withColumn("t", _trigrams(F.col("w")))
    rows = templates.collect()
    # Whole templates, and their stretches of eight words, by half their length.
    parts = "transform(sequence(1, greatest(size(w) - 7, 1), 4), i -> slice(w, i, 8))"
    known = templates.select("family", F.explode(F.expr(f"concat(array(w), {parts})")).alias("w"))
    phrases = sorted({t for r in rows for t in r.t})
    active = sorted(r[0] for r in known.select(F.explode(_slots(F.col("w")))).distinct().collect())
    place = {slot: i for i, slot in enumerate(active)}
    classes = [UNKNOWN, *FAMILIES]
    model = Model([], [], classes, [place.get(slot, -1) for slot in range(SLOTS)], 0.0, {}, {})
    model.trigrams = {f: [list(r.t) for r in rows if r.family == f and r.t] for f in FAMILIES}
    model.short = {f: [" ".join(r.w) for r in rows if r.family == f and not r.t] for f in FAMILIES}
    stored = materialise(_counted(docs, phrases, model, keep))
    counted = stored.where("not phrased")
    taught = counted.where("not kept_out").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    weight = min(1.0, UNKNOWN_WEIGHT / max(taught.n or 0, 1))
    training = known.select("family", _hits(F.col("w"), model).alias("hits"), F.lit(1.0).alias("weight"))
    training = training.union(counted.where("not kept_out").select(F.lit(UNKNOWN), "hits", F.col("n") * weight))
    label = F.array_position(F.lit(classes), F.col("family")) - 1
    training = training.select(label.cast("double").alias("label"), "weight", F.col("hits").cast("array<string>").alias("places"))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(active))], "places", "features").setBinary(True).transform(training)
    # Every iteration is a job; few rows make few tasks.
    vectors = vectors.drop("places").coalesce(2 + taught.rows // ROWS_A_TASK)
    # Labels are numbered from unknown on; a corpus without other paragraphs teaches the families alone.
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=40, weightCol="weight").fit(materialise(vectors))
    model.weights = [float(x) for row in fitted.coefficientMatrix.toArray() for x in row]
    model.intercepts = [float(x) for x in fitted.interceptVector]
    # Paragraphs rightly called unknown pass no threshold.
    verdicts = counted.where("kept_out").select("n", _verdict(F.col("hits"), model).alias("v"))
    passing = F.when(F.col("v.family") == UNKNOWN, 0.0).otherwise(F.col("v.probability"))
    steps = sorted(verdicts.groupBy(F.ceil(passing * STEPS).cast("int").alias("step")).agg(F.sum("n").alias("n")).collect())
    high, left = 0, sum(r.n for r in steps) * (1 - PASS)
    for r in steps:
        if left <= 0:
            break
        high, left = r.step, left - r.n
    model.threshold = max(0.5, high / STEPS)
    near = stored.where("found is not null").select("found", "hits", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return model, near.select("found.doc_id", "found.paragraph", "found.line", "hits")


def _counted(docs: DataFrame, phrases: list[str], model: Model, keep: bool) -> DataFrame:
    """(hits, kept_out, phrased, found, n): the paragraphs without template phrases by what they hit, half of them kept out.

    With ``keep``, those that can be confirmed stay single, named by ``found``.
    """
    pairs = {" ".join(t.split(" ")[:2]) for t in phrases}
    spark = docs.sparkSession
    ends = spark.createDataFrame([(p.split(" "),) for p in sorted(pairs)], "w array<string>")
    ends = {model.active[r[0]] for r in ends.select(_slot(F.col("w")[0], F.col("w")[1])).collect()}
    starts = _literal([i in ends for i in range(max(model.active) + 1)], "boolean")
    # A paragraph with a phrase hits the pair that begins it.
    phrased = F.when(F.exists("hits", lambda x: F.get(starts, x)), F.arrays_overlap(_trigrams(F.col("w")), F.lit(phrases))).otherwise(False)
    found = F.struct("doc_id", "paragraph", "line")
    found = F.when(_near(phrases, starts, model), found) if keep else F.when(F.lit(False), found)
    rows = paragraphs(docs).select("doc_id", "paragraph", "line", "w", _hits(F.col("w"), model).alias("hits"))
    row = F.struct("hits", (F.pmod(F.xxhash64("w"), F.lit(2)) == 0).alias("kept_out"), phrased.alias("phrased"), found.alias("found"))
    # Unnested from a list of one or none, so that the hits are not made again for the test.
    rows = rows.select(F.explode_outer(F.filter(F.array(row), lambda p: ~p["phrased"] | p["found"].isNotNull())).alias("p")).where("p is not null")
    return rows.groupBy("p.hits", "p.kept_out", "p.phrased", "p.found").agg(F.count("*").alias("n"))


def _near(phrases: list[str], starts: Column, model: Model) -> Column:
    """Whether a paragraph shares a trigram with a template, marks left out, or is a short statement; cheap tests on its hits come first."""
    spark = SparkSession.active()
    words = spark.createDataFrame([(words[0],) for words in _signs(model)], "w string")
    marks = {model.active[r[0]] for r in words.select(_slot(F.col("w"))).collect()}
    marks = _literal([i in marks for i in range(max(model.active) + 1)], "boolean")
    short = sorted({t for per in model.short.values() for t in per})
    # Where no mark stands between words, a trigram has the pair that begins it.
    loose = (F.size("w") < 3) | F.exists("hits", lambda x: F.get(starts, x)) | (F.size(_said(F.col("w"))) < F.size("w"))

    def said(w: Column) -> Column:
        return _bind(_trigrams(w), lambda t: F.when(F.size(t) > 0, F.arrays_overlap(t, F.lit(phrases))).otherwise(F.concat_ws(" ", w).isin(short)))

    return F.when(F.exists("hits", lambda x: F.get(marks, x)), F.when(loose, _bind(_said(F.col("w")), said)))


def _literal(values: list, kind: str) -> Column:
    """A list as one constant, which is parsed once when the query is planned."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _hits(w: Column, model: Model) -> Column:
    """Places of the features of the words, in order; pairs count where both words are features."""
    look = _literal(model.active, "int")

    def of_words(places: Column) -> Column:
        both = lambda x, i: F.when((x >= 0) & (F.get(places, i + 1) >= 0), F.get(look, _slot(F.get(w, i), F.get(w, i + 1))))
        return F.array_sort(F.array_distinct(F.filter(F.concat(places, F.transform(places, both)), lambda x: x >= 0)))

    return _bind(F.transform(w, lambda x: F.get(look, _slot(x))), of_words)


def _verdict(hits: Column, model: Model) -> Column:
    """(family, probability): the likeliest class of a paragraph's features."""
    width = len(model.weights) // len(model.classes)

    def score(hits: Column, f: int) -> Column:
        weights = _literal(model.weights[f * width : (f + 1) * width], "double")
        return F.aggregate(hits, F.lit(model.intercepts[f]), lambda a, x: a + F.get(weights, x))

    def best(scores: Column, top: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        family = F.element_at(F.lit(model.classes), F.array_position(scores, top).cast("int"))
        return F.struct(family.alias("family"), (1 / total).alias("probability"))

    def of_hits(hits: Column) -> Column:
        return _bind(F.array(*[score(hits, f) for f in range(len(model.classes))]), lambda scores: _bind(F.array_max(scores), lambda top: best(scores, top)))

    return _bind(hits, of_hits)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, covered, line): the confirmed licence paragraphs.

    A paragraph is a line with at least one word; ``covered`` is the share of the shorter one's word
    trigrams that it has in common with the family's best template, or 1 where it has none (comment
    marks apart) and is one of the family's short statements. Predictions of less than ``COVERED``, or
    below the threshold, are unknown and give no row.

    Null and empty texts have no paragraphs; null doc_ids are carried and repeated rows give repeated
    results. Other columns do not matter; an empty table gives an empty result.
    """
    if model is None:
        model, rows = _learnt(docs, True)
        rows = rows.withColumn("w", paragraph_words(F.col("line")))
    else:
        rows = paragraphs(docs, _signs(model)).withColumn("hits", _hits(F.col("w"), model))
    rows = rows.withColumn("v", _verdict(F.col("hits"), model))
    # Unnested from a list of one or none, so that the test isn't made below again with all it needs.
    sure = F.filter(F.array("v"), lambda v: (v["family"] != UNKNOWN) & (v["probability"] >= model.threshold))
    found = rows.select("doc_id", "paragraph", "line", "w", F.explode_outer(sure).alias("v")).where("v is not null")
    found = found.select("doc_id", "paragraph", "line", "v", _trigrams(_said(F.col("w"))).alias("_t"), F.concat_ws(" ", _said(F.col("w"))).alias("_w"))

    def share(template: list[str]) -> Column:
        t = F.lit(template)
        return F.size(F.array_intersect("_t", t)) / F.greatest(F.lit(1), F.least(F.size("_t"), F.size(t)))

    covered = F.lit(0.0)
    for family, templates in model.trigrams.items():
        shares = [*[share(t) for t in templates], ((F.size("_t") == 0) & F.col("_w").isin(model.short[family])).cast("double")]
        covered = F.when(F.col("v.family") == family, F.greatest(F.lit(0.0), *shares)).otherwise(covered)
    found = found.withColumn("covered", covered).where(F.col("covered") >= COVERED)
    return found.select("doc_id", "paragraph", "v.family", "v.probability", "covered", "line")
