"""Helpers that the operators share: stored tables, word runs, hashed words, small array tools."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docvet.session import ensure_checkpoint_dir

#: Bytes of a text that are turned into words at once; longer texts are read in runs of about this size.
RUN_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPACE_TEXT = re.compile(r"[\x20\x09-\x0D]")


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the folder that all executors share and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """k1, k2: 128 bits that are never null; rows that agree in id and text have the same keys and count as one document."""
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(f"k{k}") for k in (1, 2)]


def byte_runs(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces of about RUN_BYTES that end before white space, so that no word is cut."""
    start = 0
    while len(data) - start > RUN_BYTES:
        cut = _SPACE.search(data, start + RUN_BYTES)
        if cut is None:
            break
        yield data[start:cut.start()]
        start = cut.start()
    yield data[start:] if start else data


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """XXH64 of each word as uint64; `known` remembers words and is bounded by its owner."""
    h = xxhash.xxh64_intdigest
    out = np.empty(len(words), dtype=np.uint64)
    try:
        out[:] = [known[w] for w in words]
    except KeyError:
        for w in set(words):
            if w not in known:
                known[w] = h(w)
        out[:] = [known[w] for w in words]
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One uint64 for each run of n words, by a mixing polynomial; fewer than n words: none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = words[:count].copy()
        for k in range(1, n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out += words[k:k + count]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected bigint pairs (a, b): root is the least node that it reaches.

    Alternating large and small stars; every round is stored. Each join reads two stored tables, so that the
    adaptive planner can split a star that holds a large share of the pairs.
    """
    edges = stored(pairs.where("a <> b").selectExpr("least(a, b) AS lo", "greatest(a, b) AS hi").distinct())
    before = None
    while True:
        state = edges.selectExpr("count(*)", "coalesce(sum(CAST(xxhash64(lo, hi) AS DECIMAL(38, 0))), 0)").first()
        if state[0] == 0 or tuple(state) == before:
            return edges.selectExpr("hi AS node", "lo AS root").union(edges.selectExpr("lo AS node", "lo AS root").distinct())
        before = tuple(state)
        both = edges.selectExpr("lo AS u", "hi AS v").union(edges.selectExpr("hi AS u", "lo AS v"))
        least = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        large = stored(both.where("v > u").join(least, "u").selectExpr("m AS lo", "v AS hi").distinct())
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")))
        moved = large.join(least, "hi").where("lo <> m").selectExpr("m AS lo", "lo AS hi")
        edges = stored(moved.union(least.selectExpr("m AS lo", "hi")).distinct())


def text_runs(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text in pieces of about RUN_BYTES characters that end before white space."""
    start = 0
    while len(text) - start > RUN_BYTES:
        cut = _SPACE_TEXT.search(text, start + RUN_BYTES)
        if cut is None:
            break
        yield start, text[start:cut.start()]
        start = cut.start()
    yield start, text[start:]
