import math

import pytest

from docvet.llm import license_scan as L

TEXTS = [
    (1, "Some prose here.\nReleased under the MIT License.\nMore prose."), (2, "All rights reserved."), (3, "Das ist mit der anderen Arbeit."), (4, None), (5, ""),
    (6, "Licensed under the Apache License, Version 2.0.\nLicensed under the Frobnicate License."), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."),
    (8, "This work is licensed under the GNU General Public License, version 3."), (9, "The version of this file is old. " * 20_000 + "\nReleased under the MIT license."),
    (None, "Released under the MIT License."),
]


@pytest.fixture(scope="module")
def model(spark, make_docs):
    prose = [(k, "\n".join(f"The people of town {k} walk by the river {j} and use it with care." for j in range(4))) for k in range(60)]
    return L.fit(make_docs(prose + TEXTS))


def test_families(spark, make_docs, model):
    got = {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in L.scan(make_docs(TEXTS), model).collect()}
    assert {(1, 1, "MIT", True), (2, 0, "Proprietary", True), (6, 0, "Apache-2.0", True), (7, 0, "CC-BY-NC", True), (8, 0, "GPL", True), (9, 1, "MIT", True), (None, 0, "MIT", True)} <= got
    assert not any(d in (3, 4, 5) for d, *_ in got) and {f for d, p, f, _ in got if (d, p) == (6, 1)} == {"unknown"}
    assert L.scan(make_docs(TEXTS), model).where("doc_id = 7").count() == 2 and L.scan(make_docs(TEXTS).where("false"), model).count() == 0


def test_scores_equal_plain_arithmetic(spark, make_docs, model):
    weights, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    for r in L.scan(make_docs(TEXTS), model).where("paragraph < 2 AND doc_id < 9").collect():
        at = [k for k, f in enumerate(model.features) if f in L.grams_in(r.notice)]
        raw = (bias + weights[:, at].sum(axis=1)) / model.temperature
        top = max(raw)
        assert model.classes[list(raw).index(top)] == r.best_family and math.isclose(r.probability, 1 / sum(math.exp(x - top) for x in raw), rel_tol=1e-9)


def test_every_feature_has_its_anchor(model):
    assert all(set(f.split(" ")) & set(model.anchors) for f in model.features)


WRAPPED = {
    "GPL": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.",
    "Apache-2.0": " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.",
    "BSD": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
    "LGPL": "Licensed under the GNU\r\nLesser General Public\r\nLicense.",
}


def test_wrapped_notices(spark, make_docs, model):
    rows = [(k, f"Some prose before it.\n\n{t}\n\nProse after it.") for k, t in enumerate(WRAPPED.values())]
    got = sorted((r.doc_id, r.family) for r in L.scan(make_docs(rows), model).collect())
    assert got == [(k, f) for k, f in enumerate(WRAPPED)]


def test_anchors_lose_nothing(spark, make_docs, model, monkeypatch):
    rows = TEXTS[:8] + [(20 + k, f"Prose.\n{t}") for k, t in enumerate(WRAPPED.values())] + [(40 + k, f"The town {k} has a license office.\nIts copy shop is free.") for k in range(5)]
    found = lambda: sorted((tuple(r) for r in L.scan(make_docs(rows), model).collect()), key=str)
    want = found()
    every = L.paragraphs
    monkeypatch.setattr(L, "paragraphs", lambda docs, pattern, *names: every(docs, None, *names))
    assert found() == want and want


def test_empty_corpus(spark, make_docs):
    own = L.fit(make_docs([]))
    got = L.scan(make_docs(TEXTS), own).where("doc_id IN (1, 8)").collect()
    assert sorted((r.doc_id, r.family) for r in got) == [(1, "MIT"), (8, "GPL")]
