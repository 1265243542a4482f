"""Tables whose rows are dealt by the hash of a key, so that joins on the key move the other side only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.session import ensure_checkpoint_dir

LEAST_BUCKETS = 8


def buckets_for(amount: int, each: int) -> int:
    """A power of two that keeps about ``each`` in a bucket."""
    return max(LEAST_BUCKETS, 1 << max(0, (amount - 1) // each).bit_length())


def bucketed_table(df: DataFrame, key: str | tuple[str, ...], buckets: int, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder as a table, one file for each bucket (and value of ``partition_by``), sorted by key; rows move once.

    A key is a column or several. A filter on one key reads its bucket only. All rows of one key lie in one bucket.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = (key,) if isinstance(key, str) else key
    name = f"docvet_{key[-1]}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *key).write.format("parquet").bucketBy(buckets, *key).sortBy(*key)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    return spark.table(name)


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
