"""A training corpus from documents: five stages, each written as Parquet and read again by the next.

quality (6) drops what importance resampling rejects, lines (9) removes repeated passages, near_duplicates (2) leaves one
document of each class by fingerprints and then by shingle sets, decontamination (4) drops documents that hold test items, packing (5) gives the pieces of windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docvet.llm import contamination, importance, line_windows, near_copies, simhash
from docvet.llm.common import stored
from docvet.llm.queries import packed


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of `docs`, with n_chars of the text as it is now; a null text keeps what it had."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return changed.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free = lambda name: next(n for k in range(len(docs.columns) + 1) if (n := f"{name}_{k}") not in docs.columns)
    return _like(docs, line_windows.remove_repeats(docs, lines_col=free("lines"), removed_col=free("removed")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that the fingerprints' trie links, and of those one of each class of near copies, which differ in more bits."""
    return near_copies.keep_one(simhash.keep_one(docs)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing),
]
#: SQL can express neither the sampling nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
