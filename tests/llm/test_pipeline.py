"""The stages on the smallest tables, each against what its own input says."""

from collections import Counter

import pytest

import corpus_pipeline as C
from docvet.llm import line_windows
from docvet.llm.queries import QUERIES
from tests.llm.test_contamination import smith_waterman
from tests.llm.test_line_windows import brute as lines_brute
from tests.llm.test_near_copies import brute as copies_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_keeps_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert all(i in kept for i, q in labels.items() if q == 1) and not any(i in kept for i, q in labels.items() if q == 0)


def test_lines(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i: "".join(x for k, x in enumerate(line_windows.split_lines(t)) if k not in set(g)) for (i, t), g in lines_brute(rows).items()}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_near_duplicates(stages):
    """One document of each class of texts whose five-word shingles are alike by 0.8."""
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = copies_brute(rows)
    assert Counter(r.doc_id for r in stages[3].collect()) == Counter(want)
    assert len(want) < len(rows)


def test_decontamination(spark, stages):
    tests = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[3].collect():
        holds = any(t in r.text for t in tests)
        assert not (holds and r.doc_id in kept)
        if r.doc_id not in kept and not holds:
            words = [t.lower().split() for t in tests]
            assert max(smith_waterman(t, r.text.lower().split()) / len(t) for t in words) > 0.3


def test_packing(spark, stages):
    total = {}
    for r in stages[5].orderBy("sequence_id", "offset").collect():
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert max(total.values()) <= 2048
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == {r.doc_id for r in stages[4].collect()}


ODD = "doc_id bigint, text string, lang string, source string, n_chars int, lines string, removed int, k1 string, h1 bigint, score double"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), f"mine {k}", k, "k", 5, 0.5) for k, (i, t) in enumerate(rows)], ODD)


def test_odd_rows_through_all_stages(spark, odd_rows):
    """Nulls, empty and long texts, repeated rows and columns that the operators use themselves: their values stay, their types too."""
    tests = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    prose = [(7000 + k, f"Document number {k} speaks of matters {k * k} and of {k % 7} rivers. " * 5) for k in range(30)]
    rows = [*odd_rows, *prose, (8000, f"Before it stands this. {tests[0]} After it stands that.")]
    docs = odd(spark, rows)
    given = {(r.doc_id, r["lines"], r.removed, r.k1, r.h1, r.score) for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.schema == docs.schema or [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in docs.schema]
        kept = after.collect()
        assert {(r.doc_id, r["lines"], r.removed, r.k1, r.h1, r.score) for r in kept} <= given and len(kept) <= docs.count()
        assert all(r.n_chars == len(r.text or "") for r in kept) or name != "lines"
        docs = spark.createDataFrame(kept, docs.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert 8000 not in ids
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == ids


def test_empty_tables_through_all_stages(spark):
    docs = odd(spark, [])
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
        docs = docs if name == "packing" else spark.createDataFrame([], docs.schema)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
