"""Stable identifiers and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of sha256 over the parts joined by ':'; null if any part is null."""
    pieces: list[Column] = []
    for index, part in enumerate(parts):
        if index:
            pieces.append(F.lit(":"))
        pieces.append(part.cast("string"))
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 16)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), short_hash(*parts))


def typed_id(kind: Column, *parts: Column) -> Column:
    """Id whose prefix is itself a column (graph nodes and edges)."""
    return F.concat(kind, F.lit("_"), short_hash(kind, *parts))


def canonical_json(*columns: str) -> Column:
    """JSON object with sorted keys and explicit nulls, in Spark's number format."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def _slice_sum(row_hash: Column, index: int) -> Column:
    word = F.conv(F.substring(row_hash, 1 + 15 * index, 15), 16, 10)
    return F.coalesce(F.sum(word.cast("decimal(20,0)")), F.lit(0)).cast("string")


def multiset_digest(row_hash: Column) -> Column:
    """Aggregate: order-free digest of a group of row hashes.

    Four 60-bit slices of every sha256 are summed and hashed with the row count, so a group of
    any size folds map-side and never has to be collected or sorted in one task.
    """
    sums = [_slice_sum(row_hash, i) for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count(row_hash).cast("string"), *sums), 256)
