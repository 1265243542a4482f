"""File sources: folder scan with admission control, text decode, JSONL labels, digests."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.sources.folder_source import FolderSource

# Admitted extensions, ignored path parts and the size limit.
ALLOWED_EXTENSIONS = (".md", ".markdown", ".json", ".yaml", ".yml", ".txt", ".toml")
IGNORED_NAMES = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "raw_artifacts", "parsed_artifacts", "evidence_spans",
)
MAX_FILE_BYTES = 1_000_000

LABEL_SCHEMA = """record_id STRING, labels STRUCT<has_prompt_injection: BOOLEAN, has_tool_poisoning: BOOLEAN,
 has_permission_overreach: BOOLEAN, has_credential_risk: BOOLEAN, has_external_exfiltration_risk: BOOLEAN,
 has_suspicious_obfuscation: BOOLEAN, expected_policy_decision: STRING>,
 annotation_tags ARRAY<STRING>, label_rationale STRING"""


def suffix(path: Column) -> Column:
    """Lower-case file extension; names like '.env' or 'x.' have none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def admission(
    listing: DataFrame,
    path: str = "relative_path",
    size: str = "size_bytes",
    allowed_extensions: Iterable[str] = ALLOWED_EXTENSIONS,
    ignored_names: Iterable[str] = IGNORED_NAMES,
    max_file_size_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Add ``extension`` and ``skip_reason`` (null = admitted), cheapest check first."""
    ignored = F.array(*[F.lit(n) for n in sorted(set(ignored_names))])
    allowed = sorted({e.lower() for e in allowed_extensions})
    extension = suffix(F.col(path))
    reason = (
        F.when(F.arrays_overlap(F.split(F.col(path), "/"), ignored), "ignored_path")
        .when(~extension.isin(allowed), "unsupported_extension")
        .when(F.col(size) > max_file_size_bytes, "file_too_large")
    )
    return listing.select("*", extension.alias("extension"), reason.alias("skip_reason"))


def list_folder(spark: SparkSession, root: str, contents: bool = False, **options: object) -> DataFrame:
    """Every file and folder below a folder, hidden names included; ``contents`` opens the files that the options of the source allow."""
    if "://" in root:
        raise ValueError("Only local folder paths are supported.")
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("folder").option("contents", str(contents).lower())
    for name, value in options.items():
        reader = reader.option(name, json.dumps(value))
    return reader.load(root)


def scan_folder(
    spark: SparkSession, root: str, allowed_extensions: Iterable[str] = ALLOWED_EXTENSIONS, ignored_names: Iterable[str] = IGNORED_NAMES, max_file_size_bytes: int = MAX_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(admitted files with hash and content, skipped paths with a reason).

    Files under an ignored folder are dropped; every folder at or below one is reported. Files that aren't admitted aren't opened.
    """
    limits = dict(allowed_extensions=tuple(allowed_extensions), ignored_names=tuple(ignored_names), max_file_size_bytes=max_file_size_bytes)
    options = dict(extensions=sorted({e.lower() for e in limits["allowed_extensions"]}), ignoredNames=sorted(set(limits["ignored_names"])), maxFileBytes=max_file_size_bytes)
    checked = admission(list_folder(spark, root, contents=True, **options).where("NOT is_folder"), **limits)
    files = checked.where(F.col("skip_reason").isNull()).select(
        "root_path", "relative_path", F.concat_ws("/", "root_path", "relative_path").alias("absolute_path"), "extension", "size_bytes",
        F.sha2("content", 256).alias("content_hash"), "content",
    )
    listed = list_folder(spark, root)
    named = admission(listed, **limits).where(F.when(F.col("is_folder"), F.col("skip_reason") == "ignored_path").otherwise(F.col("skip_reason") != "ignored_path"))
    return files, named.select("root_path", "relative_path", F.col("skip_reason").alias("reason"))


#: A repository tree: one JSON line for each path.
TREE_SCHEMA = "repo STRING, path STRING, type STRING, size BIGINT"


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Tree listings as JSON lines; items without a path or of another type than blob or tree are left out, and sizes below 0 are errors of the listing."""
    rows = spark.read.schema(TREE_SCHEMA).json(path)
    return rows.where(F.col("path").isNotNull() & F.col("type").isin("blob", "tree") & F.coalesce(F.col("size") >= 0, F.lit(True)))


def decode_text(content: Column) -> Column:
    """UTF-8 text with bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_label_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
