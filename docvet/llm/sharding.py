"""Sharding by a two-pass external shuffle.

Pass one scatters the records by seeded hashes into buckets that fit into memory; pass two shuffles each bucket
(Fisher-Yates, seeded) and writes it. A record's shard follows from its id and the number of shards alone, by a jump
hash, so that one more shard takes records only into itself; within its shard a record goes to a uniform bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docvet.llm.common import stored

_STEP = 2862933555777941757
_WRAP = np.uint64(1)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Consistent bucket of each uint64 key: from n to n + 1 shards a key stays or moves to the new one."""
    keys = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(keys), dtype=np.int64)
    ahead = np.zeros(len(keys), dtype=np.float64)
    going = np.ones(len(keys), dtype=bool)
    with np.errstate(over="ignore"):
        while going.any():
            at[going] = ahead[going].astype(np.int64)
            keys[going] = keys[going] * np.uint64(_STEP) + _WRAP
            ahead[going] = (at[going] + 1) * (float(1 << 31) / ((keys[going] >> np.uint64(33)).astype(np.float64) + 1))
            going &= ahead < shards
    return at.astype(np.int32)


def _place(seed: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("id_hash").to_numpy().view(np.uint64)
            cols = [c for c in b.schema.names if c != "id_hash"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in cols), pa.array(jump_hash(keys, shards)), pa.array(jump_hash(keys, shards + 1))], [*cols, "shard", "grown_shard"]
            )

    return run


def shard_documents(
    docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Every row of `docs` as (doc_id, text, size, shard, slot, grown_shard); slots of a shard run from 0 without a gap.

    Written to `path` (below the shared folder if not given) as Parquet in folders shard=N, one file or more for each
    bucket. `bucket_bytes` bounds what a task holds, but for a single larger text. A null text is kept and has size 1, a
    null id hashes as a value of its own. Repeated rows share a shard, as their id asks, but scatter over its buckets, so
    that no task holds them all. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint").alias("size")
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = max(8, -(-total // (bucket_bytes * shards)))
    fields = "doc_id bigint, text string, size bigint, scatter bigint, shard int, grown_shard int"
    placed = (
        rows.select("doc_id", "text", "size", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("scatter"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint")).alias("id_hash"))
        .mapInArrow(_place(seed, shards), fields)
        .withColumn("bucket", (F.col("shard") * per_shard + F.pmod("scatter", F.lit(per_shard))).cast("int"))
    )

    def shuffle(bucket: tuple, table: pa.Table) -> pa.Table:
        """Records in order of their scatter hash, so that a task that runs again deals the same, then exchanged by Fisher-Yates."""
        table = table.take(pc.sort_indices(table, sort_keys=[("scatter", "ascending"), ("doc_id", "ascending")]))
        order = np.arange(table.num_rows)
        draw = np.random.default_rng([seed, bucket[0].as_py()]).integers(0, np.arange(1, table.num_rows + 1))
        for k in range(table.num_rows - 1, 0, -1):
            j = draw[k]
            order[k], order[j] = order[j], order[k]
        table = table.take(pa.array(order)).drop_columns(["scatter"])
        return table.append_column("place", pa.array(np.arange(table.num_rows, dtype=np.int64)))

    dealt = placed.repartition(max(shards * per_shard // 4, 8), "bucket").groupBy("bucket").applyInArrow(
        shuffle, "doc_id bigint, text string, size bigint, shard int, grown_shard int, bucket int, place bigint"
    )
    if path is None:
        written = stored(dealt)
    else:
        dealt.write.mode("errorifexists").partitionBy("shard").parquet(path)
        written = spark.read.schema(dealt.schema).parquet(path)
    counts = stored(written.groupBy("shard", "bucket").agg(F.count("*").alias("n")))
    before = counts.selectExpr("bucket", "n", "sum(n) OVER (PARTITION BY shard ORDER BY bucket) - n AS base").select("bucket", "base")
    return written.join(F.broadcast(before) if shards * per_shard <= 1_000_000 else before, "bucket").selectExpr(
        "doc_id", "text", "size", "shard", "base + place AS slot", "grown_shard"
    )
