"""A labelled id that holds many rows counts once: in what the driver gets, in the level and in the calibration."""

import random

import numpy as np

from docvet.llm import importance, toxicity


def _tables(spark, repeats):
    rng = random.Random(15)
    text = lambda c: " ".join(rng.choice((c, "w")) + str(rng.randrange(60)) for _ in range(40))
    rows = [(k, text("g" if k % 2 else "b")) for k in range(60)]
    docs = rows + [rows[3]] * repeats + [rows[4]] * repeats
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(60)], "doc_id bigint, quality int, toxic int")
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), labels


def test_toxicity_field_is_that_of_single_rows(spark):
    one, many = (toxicity.fit(*_tables(spark, n)) for n in (0, 300))
    assert np.allclose(one.weights, many.weights) and np.isclose(one.slope, many.slope) and np.isclose(one.offset, many.offset)


def test_importance_sample_has_one_row_of_an_id(spark, monkeypatch):
    sizes = []
    level = importance._level
    monkeypatch.setattr(importance, "_level", lambda good, bad: sizes.append((len(good), len(bad))) or level(good, bad))
    for n in (0, 300):
        importance.fit(*_tables(spark, n))
    assert sizes[0] == sizes[1] and sum(sizes[0]) <= 60
