"""Sections and splits against a plain scan, and in linear time on extreme texts."""

import random
import re
import time

from pyspark.sql import functions as F

from docvet.operators.chunking import chunk_artifacts

FIELDS = "artifact_id string, path string, raw_text string"


def plain_chunks(text, max_chars, max_lines):
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    marks = [(n, len(m[1]), m[2].strip()) for n, line in enumerate(lines) if (m := re.match(r"^(#{1,6})\s+(.+?)\s*$", line))]
    sections = []
    if marks:
        if any(x.strip() for x in lines[: marks[0][0]]):
            sections.append((0, marks[0][0], []))
        open_ = []
        for k, (n, level, title) in enumerate(marks):
            open_ = [x for x in open_ if x[0] < level] + [(level, title)]
            sections.append((n, marks[k + 1][0] if k + 1 < len(marks) else len(lines), [t for _, t in open_]))
    else:
        start = None
        for n, line in enumerate([*lines, ""]):
            if line.strip() and start is None:
                start = n
            elif not line.strip() and start is not None:
                sections.append((start, n, []))
                start = None
    out = []
    for start, end, path in sections:
        at = start
        while at < end:
            stop, size = at + 1, len(lines[at])
            while stop < end and stop - at < max_lines and size + len(lines[stop]) + 1 <= max_chars:
                size += len(lines[stop]) + 1
                stop += 1
            out.append((at + 1, stop, path, "\n".join(lines[at:stop]).strip()))
            at = stop
    return out


def test_against_a_plain_scan(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["# A", "## B b", "### C", "###### F", "## B2", "", "  ", "word " * rng.randrange(12), "x" * rng.randrange(70)]) for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += ["\n".join(rng.choice(["", "p", "line of words", "y" * 41]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "\n", "\n\n\n", "one"]
    for limits in ((40, 5), (1200, 80), (1, 1)):
        got = {}
        for r in chunk_artifacts(spark.createDataFrame([(str(k), "p.md", t) for k, t in enumerate(texts)], FIELDS), *limits).orderBy("chunk_index").collect():
            got.setdefault(r.artifact_id, []).append((r.start_line, r.end_line, r.heading_path, r.text))
        for k, t in enumerate(texts):
            assert got.get(str(k), []) == plain_chunks(t, *limits), (t, limits)


def test_null_text_and_empty_table(spark):
    assert chunk_artifacts(spark.createDataFrame([("a", "p", None)], FIELDS)).collect() == []
    assert chunk_artifacts(spark.createDataFrame([], FIELDS)).collect() == []


def test_many_headings_and_many_lines_take_linear_time(spark):
    headings = "\n".join("#" * (1 + k % 6) + f" h{k}" for k in range(250_000))
    rows = [("h", "p", headings), ("l", "p", "a\n" * 500_000), ("m", "p", "# x\n" + "b\n" * 500_000)]
    start = time.time()
    got = {r.artifact_id: r.n for r in chunk_artifacts(spark.createDataFrame(rows, FIELDS)).groupBy("artifact_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"h": 250_000, "l": 6250, "m": 6251}
    assert time.time() - start < 60
