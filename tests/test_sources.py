"""The folder source, tree and label files, and the clustered store."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from docvet.operators import lines as L
from docvet.sources import files as S
from docvet.sources import folder_source
from docvet.sources import stores as ST
from docvet.sources.bucketed import bucketed_table


def make(root, files):
    for path, content in files.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(content)


FILES = {
    ".well-known/ai-plugin.json": b"{}", "_docs/x.md": b"# x", "README.MD": b"hi", "docs/.hidden.txt": b"h", "docs/deep/_a/b.yaml": b"a: 1", ".env": b"KEY=1", "noext": b"", "big.md": b"y" * 60,
    "src/a.py": b"x", "node_modules/lib/x.md": b"z", "pkg/.git/objects/o.txt": b"g", "odd name's.md": b"q", "a.b/c.toml": b"t", "trailing.": b"",
}


def plain(root, limit):
    files, skipped = set(), set()
    for path in root.rglob("*"):
        rel = path.relative_to(root).as_posix()
        if set(path.relative_to(root).parts) & set(S.IGNORED_NAMES):
            if path.is_dir():
                skipped.add((rel, "ignored_path"))
        elif path.is_file():
            if path.suffix.lower() not in S.ALLOWED_EXTENSIONS:
                skipped.add((rel, "unsupported_extension"))
            elif path.stat().st_size > limit:
                skipped.add((rel, "file_too_large"))
            else:
                files.add((rel, path.read_bytes()))
    return files, skipped


@pytest.mark.parametrize("partitions", [64, 2])
def test_all_names_are_scanned(spark, tmp_path, monkeypatch, partitions):
    monkeypatch.setattr(folder_source, "PARTITIONS", partitions)
    make(tmp_path, FILES)
    os.makedirs(tmp_path / "dist/empty/inner")
    with open(tmp_path / "huge.md", "wb") as f:
        f.truncate(3 << 30)  # a file that no row could hold
    files, skipped = S.scan_folder(spark, str(tmp_path), max_file_size_bytes=50)
    want_files, want_skipped = plain(tmp_path, 50)
    assert {(r.relative_path, bytes(r.content)) for r in files.collect()} == want_files
    assert {(r.relative_path, r.reason) for r in skipped.collect()} == want_skipped
    assert {".well-known/ai-plugin.json", "_docs/x.md"} <= {p for p, _ in want_files} and ("huge.md", "file_too_large") in want_skipped


def test_filters_reach_the_listing(spark, tmp_path):
    make(tmp_path, FILES)
    rows = S.list_folder(spark, str(tmp_path), contents=True)
    small = rows.where((F.col("size_bytes") <= 2) & F.col("relative_path").endswith(".json"))
    assert [r.relative_path for r in small.collect()] == [".well-known/ai-plugin.json"]
    reader = folder_source.FolderReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([folder_source.LessThan(("size_bytes",), 3), folder_source.EqualTo(("root_path",), "x"), folder_source.StringStartsWith(("relative_path",), "docs/")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    got = {p for part in reader.partitions() for b in reader.read(part) for p in b.column("relative_path").to_pylist()}
    assert got == {"docs/.hidden.txt"}


def test_bad_roots(spark, tmp_path):
    with pytest.raises(ValueError, match="Only local"):
        S.scan_folder(spark, "https://example.com/x")
    with pytest.raises(Exception, match="not a directory"):
        S.list_folder(spark, str(tmp_path / "missing")).collect()
    (tmp_path / "none").mkdir()
    files, skipped = S.scan_folder(spark, str(tmp_path / "none"))
    assert files.count() == 0 and skipped.count() == 0


def test_tree_and_label_files(spark, tmp_path):
    items = [{"repo": "r", "path": "README.md", "type": "blob", "size": 3}, {"repo": "r", "path": "docs", "type": "tree"}, {"repo": "r", "path": "x", "type": "commit"}, {"repo": "r", "type": "blob"}, {"repo": "r", "path": "neg", "type": "blob", "size": -1}]
    (tmp_path / "tree.json").write_text("\n".join(map(json.dumps, items)) + "\nnot json\n")
    assert sorted((r.path, r.type, r.size) for r in S.read_tree(spark, f"{tmp_path}/tree.json").collect()) == [("README.md", "blob", 3), ("docs", "tree", None)]
    labels = {"has_prompt_injection": True, "expected_policy_decision": "block"}
    (tmp_path / "labels.jsonl").write_text(json.dumps({"record_id": "a", "labels": labels, "annotation_tags": ["t"], "label_rationale": "why", "other": 1}) + "\n")
    row = S.read_label_records(spark, f"{tmp_path}/labels.jsonl").first()
    assert row.record_id == "a" and row.labels.has_prompt_injection and row.labels.has_tool_poisoning is None and row.annotation_tags == ["t"]


def test_store_has_few_files_and_all_rows(spark, tmp_path):
    rows = [("hot" if k % 3 else f"s{k % 20}", f"a{k:04d}", f"p{k}", "h", "x" * 1000) for k in range(600)]
    raw = spark.createDataFrame(rows, "source_id string, artifact_id string, path string, content_hash string, raw_text string").repartition(7)
    ST.write_artifact_store(raw, raw.select("source_id", "artifact_id"), f"{tmp_path}/store", "overwrite", file_bytes=100_000)
    files = {}
    for folder, _, names in os.walk(tmp_path / "store/artifacts_raw"):
        files[os.path.basename(folder)] = sum(n.endswith(".parquet") for n in names)
    sources = {r[0] for r in rows}
    assert sum(files.values()) <= 6 + len(sources) and files["source_id=hot"] >= 3
    assert spark.read.parquet(f"{tmp_path}/store/artifacts_raw").count() == 600 and spark.read.parquet(f"{tmp_path}/store/artifacts_parsed").count() == 600


def test_spans_move_no_text(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(f"a{k}", "\n".join(f"line {j}" for j in range(k % 7))) for k in range(60)], "artifact_id string, raw_text string")
        stored = bucketed_table(texts, "artifact_id", 8)
        asked = [(f"a{k % 61}", 1 + k % 5 + (300 if k % 50 == 0 else 0), k % 9, "t") for k in range(400)]
        requests = spark.createDataFrame(asked, "artifact_id string, start_line int, end_line int, span_type string")
        got = L.resolve_span_requests(stored, requests)
        plan = got._jdf.queryExecution().executedPlan().toString()
        below = [line for line in plan.splitlines() if "raw_text" in line and "Exchange" in line]
        assert not below and re.search("SelectedBucketsCount: 8 out of 8", plan)
        lines = {r.artifact_id: r.raw_text.split("\n") if r.raw_text else [] for r in texts.collect()}
        want = []
        for a, s, e, _ in asked:
            if a in lines:
                bad = "order" if e < s else "outside" if s > len(lines[a]) else None
                want.append((a, s, e, bad, None if bad else "\n".join(lines[a][s - 1:e])[:160]))
        rows = [(r.artifact_id, r.start_line, r.end_line, None if r.error is None else "order" if "greater" in r.error else "outside", r.preview and r.preview) for r in got.collect()]
        flat = lambda x: x and x.replace("\n", " ")
        assert sorted(map(str, rows)) == sorted(str((*w[:4], flat(w[4]))) for w in want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
