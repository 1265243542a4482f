"""Mined negatives against all scores of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docvet.llm import negatives

FIELDS = "vec_id bigint, embedding array<double>, label int, id string, rank string, slot int, place string, score string, anchor string"


def brute(rows, positives=5, k=3, low=50, high=95, every=50):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    own = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v], y) for i, v, y in rows if y is not None and fine(v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (i, v, y) in enumerate(own):
        if i is None or i % every:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(v, w)), -(1 << 63)), (1 << 63) - 1), j, z) for m, (j, w, z) in enumerate(own) if m != n]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for p, j, _ in [x for x in scored if x[2] == y][:positives]:
            fits = [x for x in scored if x[2] != y and low * p <= 100 * x[0] <= high * p][:k]
            out += [(i, j, r + 1, x[1], p, x[0]) for r, x in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows, **other):
    df = spark.createDataFrame([(*r, "a", "b", 1, "c", "d", "e") for r in rows], FIELDS).repartition(3)
    return sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **other).collect()), key=str)


@pytest.mark.parametrize("blocks", [(8192, 1024, 1 << 20), (40, 3, 1 << 20), (8192, 1024, 200)])
def test_against_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("ROWS", "ANCHORS", "NUMBERS"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(4, 6))
    rows = [(k, [float(x) for x in centre[k % 4] + 0.9 * rng.normal(size=6)], int(rng.integers(0, 4))) for k in range(600)]
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[7][1], rows[50][2]), (7, rows[7][1], 0)] + [(None, rows[k][1], k % 4) for k in range(8)]
    rows += [(1001, None, 1), (1002, [1.0, None], 1), (1050, [float("nan")] * 6, 1), (1100, [float("inf")] + [0.0] * 5, 2), (1150, [1.0] * 6, None), (1200, [], 1), (1250, [2.0], 2), (1003, [1.5] * 9, 3)]
    assert mined(spark, rows) == brute(rows)


def test_ties_and_few_rows(spark):
    rows = [(k, [1.0, 0.0], k % 2) for k in range(101)] + [(k, [0.9, 0.1], 1) for k in range(200, 260)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (3, [0.9], 2), (4, [1.0], 1)]) == [(0, 4, 1, 3, 65536, 58880)]


def test_large_numbers(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([1, -1]) * rng.random() * s for s in (1e3, 1e9, 1e14)], k % 3) for k in range(120)]
    rows += [(k, [1e200, 1.0, 2.0], k % 3) for k in range(300, 310)] + [(k, [-(2.0**40), 2.0**30, 1.0], k % 3) for k in range(400, 420)]
    assert mined(spark, rows) == brute(rows)


def test_other_numbers_of_positives_and_limits(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=8)], int(rng.integers(0, 3))) for k in range(300)]
    assert mined(spark, rows, positives=9, negatives=2, low=(1, 3), high=(2, 3)) == brute2(rows)


def brute2(rows):
    own = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows]
    out = []
    for i, v, y in own:
        if i % 50:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in own if j != i), key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in scored if x[2] == y][:9]:
            out += [(i, j, r + 1, x[1], p, x[0]) for r, x in enumerate([x for x in scored if x[2] != y and p <= 3 * x[0] and 3 * x[0] <= 2 * p][:2])]
    return sorted(out, key=str)


def test_slots_are_disjoint():
    score = np.arange(12, dtype=np.float32)[None, :]
    low, high = np.array([[2, 1, 0]], dtype=object), np.array([[9, 5, 5]], dtype=object)
    held = [negatives.in_slot(score, low, high, s)[0] for s in range(3)]
    assert [np.flatnonzero(h).tolist() for h in held] == [[6, 7, 8, 9], [], [0, 1, 2, 3, 4, 5]]


def test_matrices_are_neither_shuffled_nor_sent_to_the_driver(spark, monkeypatch):
    """The anchors are a small table, but not once for each block of rows."""
    for name, value in zip(("ROWS", "ANCHORS"), (40, 3)):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame([(k, [float(k % 7), 1.0], k % 3) for k in range(400)], "vec_id bigint, embedding array<double>, label int")
    lines = negatives.mine(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    assert any("CartesianProduct" in line for line in lines)
    for n, line in enumerate(lines):
        if "Exchange" in line:
            below = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            made = next(m for m in range(n + 1, below) if "MapInArrow" in lines[m] or "Scan" in lines[m])
            assert "matrix" not in lines[made].split("MapInArrow")[0] and not any("matrix" in x for x in lines[n + 1:made])


@pytest.mark.parametrize("lines", [1, 5, 300])
def test_best_looks_at_the_greatest_of_each_run_first(lines):
    rng = np.random.default_rng(8)
    score, able = rng.integers(-9, 9, size=(lines, 1000)).astype(np.float32), rng.random((lines, 1000)) < 0.4
    able[0] = False
    want = [(n, c) for n in range(lines) for c in sorted(np.flatnonzero(able[n]), key=lambda c: (-score[n, c], c))[:3]]  # noqa: B023
    assert [tuple(x) for x in np.transpose(negatives.best(score, able, 3)).tolist()] == want
