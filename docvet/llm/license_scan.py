"""Licence notices by a trained paragraph classifier: logistic regression on word n-grams, an unknown class, a template check.

Positive paragraphs are notices of each family, and generic ones for the class "unknown"; negative ones are a bounded sample of
the corpus. Features are the n-grams of notices that ordinary paragraphs of the sample hardly have, so that a paragraph
without any of them can only be no notice: those are left out by one pattern before anything is tokenized. Probabilities are
calibrated by a temperature on notices kept from the fit. A family is confirmed if the words of one of its notices
are there; a family without that, or with too low a probability, is reported as unknown. DataFrame functions and
Spark's own estimators only: scoring is one narrow pass.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from docvet.functions.text import compute_once
from docvet.llm.common import stored

#: Notices of each family in common wordings.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT License; see LICENSE.",
        "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
        "You may not use this file except in compliance with the Apache License, Version 2.0.", "This code is under the Apache License 2.0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "You can redistribute it and modify it under the terms of the GNU General Public License.", "Licensed under the GNU General Public License, version 2 or later.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is released under the GNU LGPL.",
        "Distributed under the terms of the GNU Lesser General Public License, version 3.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the GNU AGPL v3.",
        "Distributed under the terms of the GNU Affero General Public License, version 3.",
    ),
    "BSD": (
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "Use is governed by a BSD-style license.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the Mozilla Public License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
        "Content is available under the Creative Commons Attribution License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0", "Content is available under the Creative Commons Attribution-NonCommercial License.",
    ),
    "Public-Domain": (
        "This work is dedicated to the public domain.", "Released into the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0",
        "No rights reserved; this is in the public domain.",
    ),
    "Proprietary": (
        "All rights reserved.", "Copyright by the authors. All rights reserved.", "Proprietary and confidential; no part may be reproduced without permission.",
        "Unauthorized copying of this file is strictly prohibited.",
    ),
    "unknown": (
        "Licensed under the Foo License.", "See the LICENSE file for the license terms.", "Use is subject to the license agreement.", "This product is licensed, not sold.",
        "Distributed under the terms of the license found in this folder.", "SPDX-License-Identifier: LicenseRef-Custom", "Please read the licence before use.",
    ),
}
NONE = "none"
#: How a family's short name and wordings vary: each notice also stands inside other text.
FRAMES = ("{}", "Note: {} Thanks to everyone.", "{} See below for more.", "About this text. {}")
_PLAIN = r"[^\p{L}\p{N}]+"
#: A line end within a paragraph: after something else than the end of a sentence, before a line with a letter or digit.
WRAP = r"(?<=[^.!?\s])[^\S\n]*\n(?=[^\n\p{L}\p{N}]*[\p{L}\p{N}])"


def tokens_of(text: Column) -> Column:
    """Words of a text in lower case; what is neither letter nor digit separates."""
    return F.filter(F.split(F.lower(text), _PLAIN), lambda w: w != "")


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds tokens of `body`, and grams: its distinct words and runs of two and three words joined by spaces.

    Each is computed once for a row; a run reads its neighbours by place, so that the work follows the number of words.
    """
    def run(n: int) -> Column:
        joined = F.transform("tokens", lambda w, k: F.concat(w, *[x for j in range(1, n) for x in (F.lit(" "), F.get("tokens", k + j))]))
        return F.filter(joined, lambda g: g.isNotNull())

    rows = compute_once(rows, tokens=tokens_of(F.col("body")))
    return compute_once(rows, grams=F.array_distinct(F.concat("tokens", run(2), run(3))))


@dataclass(frozen=True)
class Classifier:
    """The regression over `features`; anchors: a word of each feature; level: least calibrated probability of a family."""

    classes: tuple[str, ...]
    features: tuple[str, ...]
    regression: LogisticRegressionModel
    anchors: tuple[str, ...]
    temperature: float
    level: float


def paragraphs(docs: DataFrame, pattern: str | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, paragraph, body): the paragraphs of each text that `pattern` finds in, numbered from 0.

    A line goes on with the next one unless it ends a sentence or either is blank, so that a wrapped notice is one paragraph; signs that
    begin each line of a comment are no words.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if pattern is not None:
        rows = rows.where(F.col("text").rlike(pattern))
    joined = F.regexp_replace("text", WRAP, " ")
    rows = rows.select("doc_id", F.posexplode(F.split(joined, "\n")).alias("paragraph", "body"))
    return rows.where(F.col("body").rlike(pattern) if pattern is not None else F.trim("body") != "")


def fit(
    docs: DataFrame, max_documents: int = 1_000, max_paragraphs: int = 3_000, most_common: float = 0.004, level: float = 0.3,
    id_col: str = "doc_id", text_col: str = "text",
) -> Classifier:
    """A classifier from the notices and from at most `max_paragraphs` paragraphs of at most `max_documents` documents, both by a hash.

    Sampled paragraphs that speak of licences or copyright are no negatives and left out. Features are n-grams of notices that at
    most `most_common` of the negatives hold. An empty corpus gives a classifier from notices alone.
    """
    spark = docs.sparkSession
    ids = stored(docs.select(F.col(id_col).alias("sampled")).where("sampled IS NOT NULL").distinct().orderBy(F.xxhash64("sampled"), "sampled").limit(max_documents))
    some = docs.join(F.broadcast(ids), F.col(id_col) == F.col("sampled"), "left_semi")  # at most max_documents ids
    negative = paragraphs(some, None, id_col, text_col).where(~F.col("body").rlike(r"(?i)licen[sc]|copyright|rights reserved|spdx"))
    negative = negative.orderBy(F.xxhash64("body", "doc_id", "paragraph")).limit(max_paragraphs).select("body")
    classes = (NONE, *NOTICES)
    notices = [(classes.index(f), k % 2, frame.format(t)) for f, texts in NOTICES.items() for k, t in enumerate(texts) for frame in FRAMES]
    rows = spark.createDataFrame(notices, "label int, kept int, body string").unionByName(negative.select(F.lit(0).alias("label"), F.pmod(F.xxhash64("body"), F.lit(2)).cast("int").alias("kept"), "body"))
    rows = stored(with_grams(rows))

    wanted = sorted({g for texts in NOTICES.values() for t in texts for g in grams_in(t)})
    counts = {r.g: r.n for r in rows.where("label = 0").select(F.explode("grams").alias("g")).where(F.col("g").isin(wanted)).groupBy("g").agg(F.count("*").alias("n")).collect()}
    size = rows.where("label = 0").count()
    features = tuple(g for g in wanted if counts.get(g, 0) <= most_common * size)
    rarest = lambda g: min(g.split(" "), key=lambda w: (counts.get(w, 0), -len(w), w))
    anchors = tuple(sorted({rarest(g) for g in features}))

    counter = CountVectorizerModel.from_vocabulary(list(features), inputCol="grams", outputCol="features", minTF=1.0)
    counter.setBinary(True)
    train = counter.transform(rows).withColumn("weight", F.when(F.col("label") == 0, F.lit(1.0 if not size else max(1.0, 200.0 / size))).otherwise(F.lit(4.0)))
    train = train.withColumn("label", F.col("label").cast("double"))
    blank = spark.createDataFrame([(0.0, 20.0, [])], "label double, weight double, grams array<string>")  # ordinary text has no feature at all
    train = train.select("label", "weight", "features", "kept").unionByName(counter.transform(blank).select("label", "weight", "features", F.lit(0).alias("kept")))
    train = stored(train.coalesce(2))
    learner = LogisticRegression(maxIter=50, regParam=0.0003, family="multinomial", weightCol="weight", standardization=False)
    half = learner.fit(train.where("kept = 0"))
    held = [(int(r.label), list(r.raw)) for r in half.transform(train.where("kept = 1 AND label > 0")).select("label", vector_to_array("rawPrediction").alias("raw")).collect()]
    model = learner.fit(train)
    return Classifier(classes, features, model, anchors, _temperature(held), level)


def grams_in(text: str) -> set[str]:
    """The same n-grams, of one short text."""
    words = re.findall(r"[^\W_]+", text.lower())
    return {" ".join(words[k:k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


def _temperature(held: list[tuple[int, list[float]]]) -> float:
    """Divisor of the raw scores with the greatest likelihood of the held notices."""
    def loss(t: float) -> float:
        total = 0.0
        for label, raw in held:
            top = max(raw)
            total += math.log(sum(math.exp((x - top) / t) for x in raw)) - (raw[label] - top) / t
        return total

    return min((k / 10 for k in range(3, 51)), key=loss) if held else 1.0


def scan(docs: DataFrame, model: Classifier, least_template: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, best_family, probability, template, confirmed, notice): a row for each paragraph that is a notice.

    `family` is `best_family` where its calibrated probability reaches the model's level and a notice of it has at least
    `least_template` of its words in the paragraph, else unknown. Whole texts are read; null and empty texts and those without
    notices give no rows, repeated rows give repeated rows, and other columns are not read.
    """
    intercepts = model.regression.interceptVector.toArray().tolist()
    if intercepts[0] <= max(intercepts[1:]):
        raise ValueError("text without any feature must be no notice")
    pattern = r"(?iU)\b(" + "|".join(re.escape(a) for a in model.anchors) + r")\b"
    rows = with_grams(paragraphs(docs, pattern, id_col, text_col))
    counter = CountVectorizerModel.from_vocabulary(list(model.features), inputCol="grams", outputCol="features", minTF=1.0)
    counter.setBinary(True)
    rows = counter.transform(rows)
    raw = model.regression.setFeaturesCol("features").transform(rows).withColumn("raw", vector_to_array("rawPrediction"))
    # written, as every later expression would else repeat these; paragraphs with an anchor are few
    rows = stored(raw.where("prediction > 0").select("doc_id", "paragraph", "body", "tokens", "raw"))
    top = F.array_max("raw")
    share = F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp((x - top) / model.temperature))
    names = F.array(*map(F.lit, model.classes))
    best = F.element_at(names, F.array_position("raw", top).cast("int"))
    rows = rows.withColumns({"best_family": best, "probability": 1 / share}).where(F.col("best_family") != NONE)
    words = F.array_distinct("tokens")
    near = F.lit(0.0)
    for family, texts in NOTICES.items():
        alike = [F.size(F.array_intersect(words, F.array(*map(F.lit, t)))) / len(t) for t in (sorted({w for w in grams_in(x) if " " not in w}) for x in texts)]
        near = F.when(F.col("best_family") == family, F.greatest(*alike)).otherwise(near)
    rows = rows.withColumn("template", near).withColumn("confirmed", (F.col("template") >= least_template) & (F.col("probability") >= model.level))
    family = F.when(F.col("confirmed"), F.col("best_family")).otherwise("unknown")
    return rows.select("doc_id", "paragraph", family.alias("family"), "best_family", "probability", "template", "confirmed", F.col("body").alias("notice"))
