"""Sinks and keyed tables: artifact store, latest-per-key views, reports, bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions.ids import canonical_json
from docvet.operators.report import LINE_ORDER
from docvet.sources.bucketed import text_bytes

# The names of the reproducibility artifacts, in order.
BUNDLE_NAMES = (
    "config.yaml", "results.jsonl", "metrics_summary.json", "scan_manifest.json",
    "detector_versions.json", "policy_versions.json", "evidence_snapshot_hashes.json",
)


def write_artifact_store(artifacts: DataFrame, parsed: DataFrame, path: str, mode: str = "append", file_bytes: int = 256 << 20) -> None:
    """Raw text and parsed records go to separate tables under the same ids.

    Rows are dealt by ranges of (source, artifact) that hold about ``file_bytes`` of text each, so that a huge source spreads
    over many files, small ones share a task, and there are at most as many files as ranges and sources. Text moves once.
    """
    raw = artifacts.select("source_id", "artifact_id", "path", "content_hash", "raw_text")
    _write_clustered(raw, max(1, -(-text_bytes(raw, "raw_text") // file_bytes)), f"{path}/artifacts_raw", mode)
    _write_clustered(parsed, max(1, -(-parsed.count() // PARSED_ROWS)), f"{path}/artifacts_parsed", mode)


#: Parsed records of a file, about.
PARSED_ROWS = 1_000_000


def _write_clustered(rows: DataFrame, ranges: int, path: str, mode: str) -> None:
    rows.repartitionByRange(ranges, "source_id", "artifact_id").write.mode(mode).partitionBy("source_id").parquet(path)


def latest_per_key(records: DataFrame, keys: Sequence[str], written_at: str) -> DataFrame:
    """Last write wins: one row per key, kept by a map-side combined max instead of a sort; of rows written at once the greatest JSON form."""
    rest = [c for c in records.columns if c not in keys and c != written_at]
    newest = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(written_at), F.to_json(F.struct(*rest)))).alias("row"), F.max(written_at).alias(written_at))
    return newest.select(*keys, "row.*", written_at)


def run_finding_index(entries: DataFrame) -> DataFrame:
    """First position of each finding in a run; ``entries(run_id, pos, finding_id)``."""
    return entries.groupBy("run_id", "finding_id").agg(F.min("pos").alias("pos"))


def findings_for_runs(index: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings listed by run in index order; ids without a record are skipped."""
    return index.join(findings, "finding_id")


def write_report_json(headers: DataFrame, findings: DataFrame, path: str) -> None:
    """Report records with sorted keys: one JSON line per header and one per finding."""
    headers.select(canonical_json(*headers.columns).alias("value")).write.mode("overwrite").text(f"{path}/reports")
    findings.select(canonical_json(*findings.columns).alias("value")).write.mode("overwrite").text(f"{path}/findings")


def write_markdown_reports(lines: DataFrame, path: str) -> None:
    """One folder per run; its part files read in name order give the document."""
    ordered = lines.repartitionByRange(*LINE_ORDER).sortWithinPartitions(*LINE_ORDER)
    ordered.select("run_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)


#: What a crawl manifest may say of a file; texts and contents never go into it.
MANIFEST_PARTS = {
    "selected": ("path", "artifact_type", "priority", "size_bytes"),
    "fetched": ("path", "raw_url", "artifact_type", "size_bytes", "content_hash"),
    "skipped": ("path", "stage", "reason"),
}


def write_crawl_manifests(summaries: DataFrame, parts: dict[str, DataFrame], path: str) -> None:
    """JSON lines of the crawls' summaries, and of their selected, fetched and skipped files keyed by `repo`, without any text.

    A crawl's files are rows, not one nested record, so that a repository of any size is written by many tasks.
    """
    if set(parts) != set(MANIFEST_PARTS):
        raise ValueError(f"a manifest has the parts {', '.join(MANIFEST_PARTS)}")
    write_jsonl(summaries, f"{path}/summary")
    for name, columns in MANIFEST_PARTS.items():
        write_jsonl(parts[name].select("repo", *columns), f"{path}/{name}")


def write_jsonl(records: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; an empty frame leaves an empty folder."""
    records.select(canonical_json(*records.columns).alias("value")).write.mode("overwrite").text(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Reproducibility bundle: exactly the seven named artifacts, each as JSON lines."""
    if tuple(tables) != BUNDLE_NAMES:
        raise ValueError("a bundle holds exactly the named artifacts, in order.")
    for name, df in tables.items():
        write_jsonl(df, f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.json(f"{path}/{name}")
