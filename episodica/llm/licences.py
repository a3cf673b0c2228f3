"""Find licence notices by a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines between blank lines, its words joined, so a notice may be wrapped
anywhere. As several notices may stand in one paragraph, one in a line, its lines are
looked at as well. The classifier is a multinomial logistic regression with an L1 penalty
over word n-grams (1 to 3 words). It is trained on notice templates, alone, cut short and
with lines of the corpus around them, against half of all different corpus lines and paragraphs.
The cutoff below which one is of no family is calibrated on the other half, which training does
not see. A predicted family counts as confirmed if enough three-word runs of one of its
templates occur in the line or paragraph; otherwise it is an unknown licence.

Every n-gram that is used holds an anchor, a template word that corpus lines hardly
use. A line without an anchor has no feature, so its scores are those of an empty line and
it needs no scoring; this skips no line that the classifier could place elsewhere.

Everything runs in SQL expressions; training is Spark ML.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import session
from episodica.plans.skew import ordered
from episodica.session import durable

FIT_TASKS, FIT_ROUNDS = 4, 60
PADS = 8  # corpus lines put around each notice in training
ANCHOR_SHARE = 0.002  # of the different lines
FALSE_SHARE = 0.001  # of unseen corpus lines may pass the cutoff
LEAST_CUTOFF = 0.6
CONFIRMED = 0.6
HELD = 0.3  # share of a template from which a corpus line is left out of training
UNKNOWN = "unknown"
NONE = "none"

# Usual wording of licence notices by family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Released into the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without permission."],
}


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), "")


def grams(found: Column, width: int) -> Column:
    """Runs of ``width`` words, as text."""
    starts = F.sequence(F.lit(1), F.size(found) - width + 1)
    return F.when(F.size(found) >= width, F.transform(starts, lambda i: F.array_join(F.slice(found, i, width), " "))).otherwise(F.array().cast("array<string>"))


def features(found: Column) -> Column:
    return F.array_distinct(F.concat(found, grams(found, 2), grams(found, 3)))


@dataclass(frozen=True)
class Model:
    families: list[str]  # NONE first
    terms: dict[str, list[float]]  # weights of each n-gram, one per family
    bias: list[float]
    anchors: list[str]
    cutoff: float


def _templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(family).alias("family"), F.lit(text).alias("line")) for family, texts in TEMPLATES.items() for text in texts]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _paragraphs(text: Column) -> Column:
    """Runs of lines between blank lines."""
    return F.split(text, "\n(?:[^\\S\n]*\n)+")


def _units(paragraph: Column) -> Column:
    """The lines of a paragraph as (line, whole), and if there are several the paragraph itself."""
    lines = F.split(paragraph, "\n")
    one = lambda line, whole: F.struct(line.alias("line"), F.lit(whole).alias("whole"))
    return F.concat(F.transform(lines, lambda x: one(x, False)), F.when(F.size(lines) > 1, F.array(one(paragraph, True))).otherwise(F.array().cast("array<struct<line:string,whole:boolean>>")))


def _runs(texts: list[str]) -> list[str]:
    """The three-word runs of templates."""
    return sorted({" ".join(own[i : i + 3]) for own in map(_words, texts) for i in range(len(own) - 2)})


def _plain(found: Column) -> Column:
    """Whether a line holds little of every template; one that holds much is a notice, no example of other text."""
    every = [text for texts in TEMPLATES.values() for text in texts]
    some = (F.size(F.array_intersect(found, F.lit(_own()))) > 2) & (F.size(F.array_intersect(grams(found, 3), F.lit(_runs(every)))) > 0)
    held = F.when(some, F.greatest(*[_held(found, texts) for texts in TEMPLATES.values()]))
    return F.coalesce(held < HELD, F.lit(True))


def _own() -> list[str]:
    """The words of all templates."""
    return sorted({w for texts in TEMPLATES.values() for text in texts for w in _words(text)})


def _kept(found: Column) -> Column:
    """A line's words with each run of words that no template has as one empty word.

    Every n-gram that is looked for is made of template words, so the kept words have the same ones as the line,
    and different lines mostly come down to few rows of kept words.
    """
    bare = F.array_join(F.transform(found, lambda w: F.when(w.isin(_own()), w).otherwise("")), " ")
    return F.split(F.regexp_replace(bare, " {2,}", "  "), " ")


def _names(line: Column) -> list[Column]:
    """128 bits of hash that stand for a line (or paragraph); the second half deals it to training or calibration."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(1)).alias("g")]


HALF = "pmod(g, 2)"


def _all_units(docs: DataFrame) -> DataFrame:
    """Lines and paragraphs of all texts."""
    parts = docs.select(F.explode(_paragraphs(F.col("text"))).alias("paragraph"))
    return parts.select(F.inline(_units(F.col("paragraph")))).where("trim(line) <> ''")


def _seen(docs: DataFrame) -> DataFrame:
    """Every different line of all texts with the template words it holds, and every different paragraph."""
    rows = _all_units(docs).select("whole", *_names(F.col("line")), F.when(~F.col("whole"), tokens(F.col("line"))).alias("words"))
    own = F.coalesce(F.array_join(F.array_intersect("words", F.lit(_own())), " "), F.lit(""))
    return rows.select("whole", "h", "g", own.alias("own"), _plain(F.col("words")).alias("plain")).distinct()


def _pads(docs: DataFrame, seen: DataFrame) -> list[list[str]]:
    """The words of the PADS lines of smallest hash, as surroundings of notices."""
    some = [r["h"] for r in seen.where(f"not whole and plain and {HALF} = 0").orderBy("h", "g").limit(2 * PADS).collect()]
    lines = _all_units(docs).where(~F.col("whole") & F.xxhash64("line").isin(some)).select("line").distinct() if some else None
    found = lines.select(F.xxhash64("line").alias("h"), tokens(F.col("line")).alias("words")).collect() if some else []
    return [r["words"] for r in sorted(found, key=lambda r: r["h"]) if r["words"]][:PADS]


def _near(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """Lines and paragraphs (row, doc_id, par, whole, words, h, g) of every row; kept words and hashes only where there is an anchor.

    A text without an anchor gives one row: it is not cut up.
    """
    has = lambda words: F.arrays_overlap(words, F.lit(anchors)) if anchors else F.lit(False)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # numbers rows, not lines
    rows = rows.withColumn("text", F.when(has(tokens(F.col("text"))), F.col("text")))
    rows = rows.select("row", "doc_id", F.posexplode_outer(_paragraphs(F.col("text"))).alias("par", "paragraph"))
    rows = rows.select("row", "doc_id", "par", F.inline_outer(_units(F.col("paragraph")))).withColumn("words", tokens(F.col("line")))
    rows = rows.withColumn("near", F.coalesce(has(F.col("words")), F.lit(False)))
    return rows.select("row", "doc_id", "par", "whole", *[F.when(F.col("near"), c).alias(n) for n, c in zip("words h g".split(), [_kept(F.col("words")), *_names(F.col("line"))])])


def _trained(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model fitted on the templates and all lines and paragraphs of all texts, and ``_near`` of the texts.

    A line without an anchor has no feature, so all of them are one row of that weight; lines of the same
    features are one as well. Weights count different lines, so fit and cutoff are those of all lines.
    """
    spark = docs.sparkSession
    seen = durable(_seen(docs))
    count = lambda c: F.count_if(F.expr(c))
    n_lines, *n = seen.agg(count("plain and not whole"), *[count(f"plain and {HALF} = {i}") for i in (0, 1)]).first()
    words = seen.where("plain and not whole and own <> ''").select(F.explode(F.split("own", " ")).alias("word"))
    used = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}  # template words, each once
    anchors = [w for w in _own() if len(w) > 1 and used.get(w, 0) <= ANCHOR_SHARE * max(1, n_lines)]
    units = durable(_near(docs, anchors))
    # How many different lines and paragraphs with an anchor come down to the same words, in each half.
    near = units.where("words is not null").select("whole", "h", "g", "words").distinct()
    near = near.groupBy("whole", "words").agg(*[count(f"{HALF} = {i}").alias(f"n{i}") for i in (0, 1)])
    near = durable(near.withColumn("plain", _plain(F.col("words"))))
    met = near.where("plain or whole").agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in (0, 1)]).first()
    plain = near.where("plain")
    templates = _templates(spark).withColumn("words", tokens(F.col("line")))
    anchored = lambda g: F.arrays_overlap(F.split(g, " "), F.lit(anchors))
    size = F.size("words")
    variants = templates.select("family", "words").unionByName(
        templates.where(size > 5).select("family", F.slice("words", F.lit(2), size).alias("words"))
    ).unionByName(templates.where(size > 5).select("family", F.slice("words", F.lit(1), size - 1).alias("words")))
    pads = _pads(docs, seen)
    pad = F.explode(F.array(*[F.array(*map(F.lit, p)) for p in pads])) if pads else F.lit(None).cast("array<string>")
    padded = variants.select("family", "words", pad.alias("pad"))
    padded = padded.where("pad is not null")
    positive = variants.unionByName(padded.select("family", F.concat("pad", "words").alias("words"))).unionByName(
        padded.select("family", F.concat("words", "pad").alias("words"))
    )
    families = [NONE, *sorted(TEMPLATES)]
    vocabulary = sorted(r["g"] for r in templates.select(F.explode(F.filter(features(F.col("words")), anchored)).alias("g")).distinct().collect()) if anchors else []
    if not vocabulary:
        return Model(families, {}, [0.0] * len(families), [], 1.0), units
    rows = positive.withColumn("n", F.lit(1).cast("long")).unionByName(plain.where("n0 > 0").select(F.lit(NONE).alias("family"), "words", F.col("n0").alias("n")))
    rows = rows.select("family", F.array_sort(F.array_intersect(features(F.col("words")), F.lit(vocabulary))).alias("grams"), "n")
    far = spark.range(max(0, min(1, n[0] - met[0]))).select(F.lit(NONE).alias("family"), F.array().cast("array<string>").alias("grams"), F.lit(n[0] - met[0]).cast("long").alias("n"))
    rows = durable(rows.unionByName(far).groupBy("family", "grams").agg(F.sum("n").alias("n")))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    label = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    share = rows.groupBy("family").agg((1 / F.sum("n")).alias("share"))  # each family weighs the same
    data = vectors.transform(rows.join(F.broadcast(share), "family").withColumn("label", label))
    data = data.withColumn("weight", F.col("n") * F.col("share") * len(families) * F.when(F.col("family") == NONE, 4.0).otherwise(1.0))
    fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=1e-4, maxIter=FIT_ROUNDS, weightCol="weight", standardization=False).fit(data.coalesce(FIT_TASKS))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    terms = {t: [float(x) for x in matrix[:, i]] for i, t in enumerate(vocabulary) if abs(matrix[:, i]).max() > 0}
    draft = Model(families, terms, [float(x) for x in bias], anchors, 0.0)
    # The share of unseen corpus lines that would pass as a licence bounds the cutoff from below.
    unseen = plain.where("n1 > 0").select("n1", best(F.col("words"), draft).alias("b")).where(F.col("b.family") != NONE)
    passing = unseen.groupBy((-F.col("b.chance")).alias("below")).agg(F.sum("n1").alias("n")).withColumn("all", F.lit(0))
    upto = ordered(passing, ["all"], ["below"], running={"upto": F.col("n")})
    passed = upto.where(F.col("upto") > math.floor(FALSE_SHARE * n[1])).agg(F.min("below")).first()[0]
    cutoff = max(LEAST_CUTOFF, 1e-9 - passed if passed is not None else 0.0)
    return Model(families, terms, draft.bias, anchors, min(cutoff, 1.0)), units


def train(docs: DataFrame) -> Model:
    """Fit on the templates and all lines and paragraphs of all texts."""
    return _trained(docs)[0]


def best(found: Column, model: Model) -> Column:
    """struct(family, chance): the likeliest family of a line's words."""
    start = F.lit(model.bias)
    if model.terms:
        weights = F.from_json(F.lit(json.dumps(model.terms)), "map<string,array<double>>")
        active = F.array_intersect(features(found), F.map_keys(weights))
        scores = F.aggregate(active, start, lambda acc, g: F.zip_with(acc, weights[g], lambda a, b: a + b))
    else:
        scores = start
    # (score, family) pairs: the largest one, and its softmax.
    ranked = F.zip_with(scores, F.lit(model.families), lambda s, f: F.struct(s.alias("s"), f.alias("f")))
    top = F.array_max(ranked)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top["s"]))
    return F.struct(top["f"].alias("family"), (F.lit(1.0) / total).alias("chance"))


def _held(found: Column, texts: list[str]) -> Column:
    """Largest share of the three-word runs of one of ``texts`` that a line holds."""
    runs, parts = grams(found, 3), [F.lit(0.0)]
    for text in texts:
        want = _runs([text])
        parts.append(F.size(F.array_intersect(runs, F.lit(want))) / len(want))
    return F.greatest(*parts)


def template_match(found: Column, family: Column) -> Column:
    """How much of a template of ``family`` a line holds, from 0 to 1."""
    out: Column = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        out = F.when(family == name, _held(found, texts)).otherwise(out)
    return out


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, licences, n_licence_lines, n_unknown_lines, best_chance for every row of ``docs``.

    ``licences``: confirmed families in order of name, joined by commas; ``unknown`` if there
    are only unconfirmed notices, ``none`` if there is no notice. A notice is a line, or a
    paragraph that is confirmed by its lines together: such a paragraph counts once, unless a line of it
    is confirmed for the same family, and its unconfirmed lines are parts of it. A paragraph that is a notice
    though no line of it is counts as unconfirmed. A null or empty text has none, and
    best_chance null. Repeated rows and null ids stay. Only doc_id and text are read; each
    line of every text is.
    """
    return _judged(durable(_near(docs, model.anchors)), model)


def _judged(rows: DataFrame, model: Model) -> DataFrame:
    kinds = rows.where("words is not null").select("words").distinct()  # each is judged once
    kinds = kinds.select("words", best(F.col("words"), model).alias("b"))
    hit = (F.col("b.family") != NONE) & (F.col("b.chance") >= model.cutoff)
    sure = template_match(F.col("words"), F.col("b.family")) >= CONFIRMED
    kinds = kinds.where(hit).select("words", F.col("b.family").alias("family"), F.col("b.chance").alias("chance"), sure.alias("sure"))
    named = ["row", "doc_id", "par", "whole", "family", "chance", "sure"]
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("family", "string"), ("chance", "double"), ("sure", "boolean"))]
    lines = rows.where("words is not null").join(kinds, "words", "left").select(*named)
    lines = lines.unionByName(rows.where("words is null").select(*named[:4], *blank))
    # Family names are few, so the set of them in a paragraph or a document is bounded.
    whole, line = F.col("whole"), ~F.col("whole")
    pars = lines.groupBy("row", "doc_id", "par").agg(
        F.collect_set(F.when(F.col("sure") & line, F.col("family"))).alias("of_lines"), F.max(F.when(F.col("sure") & whole, F.col("family"))).alias("of_whole"),
        F.count_if(F.col("sure") & line).alias("sure_lines"), F.count_if(~F.col("sure") & line).alias("other_lines"),
        F.count_if(~F.col("sure") & whole).alias("other_whole"), F.max("chance").alias("chance"),
    )
    joined = F.col("of_whole").isNotNull()
    new = joined & ~F.coalesce(F.array_contains("of_lines", F.col("of_whole")), F.lit(False))
    alone = (F.col("other_whole") > 0) & (F.col("sure_lines") + F.col("other_lines") == 0)
    unknown = F.when(joined, 0).when(alone, 1).otherwise(F.col("other_lines"))
    pars = pars.select(
        "row", "doc_id", F.when(new, F.array_append("of_lines", F.col("of_whole"))).otherwise(F.col("of_lines")).alias("families"),
        (F.col("sure_lines") + new.cast("int")).alias("n_sure"), unknown.alias("n_other"), "chance",
    )
    out = pars.groupBy("row", "doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("sure"), F.sum(F.col("n_sure") + F.col("n_other")).cast("long").alias("n_licence_lines"),
        F.sum("n_other").cast("long").alias("n_unknown_lines"), F.max("chance").alias("best_chance"),
    )
    name = F.when(F.size("sure") > 0, F.array_join("sure", ",")).when(F.col("n_licence_lines") > 0, UNKNOWN).otherwise(NONE)
    return out.select("doc_id", name.alias("licences"), "n_licence_lines", "n_unknown_lines", "best_chance")


def licences(docs: DataFrame) -> DataFrame:
    session(docs.sparkSession)
    model, units = _trained(docs)
    return _judged(units, model)
