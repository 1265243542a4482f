"""A keyed, versioned table for upserts from batches or a stream.

Rows lie in buckets of their key's hash. Merging a batch rewrites the buckets it touches into a folder of that batch, and then
writes the list of live folders as the next version, so that a reader sees either version whole. A batch merged again starts from
the version before it, so that a restarted stream neither loses nor doubles rows. Of rows with one key the greatest by
(order column, JSON form) stays, so that batches may come in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docvet.session import shared_table
from docvet.sources.stores import latest_per_key

_LIVE = "bucket int, batch bigint"


@dataclass(frozen=True)
class KeyedStore:
    """``schema`` is the DDL of the rows; the driver holds one number for each of the ``buckets``."""

    folder: str
    schema: str
    key: str
    order: str
    buckets: int = 16

    def create(self, spark: SparkSession) -> None:
        """An empty version before all batches."""
        self._write_live(spark, {}, -1)

    def _write_live(self, spark: SparkSession, live: dict[int, int], version: int) -> None:
        rows = spark.createDataFrame(sorted(live.items()), _LIVE).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/versions/version={version}")

    def _live(self, spark: SparkSession, below: int | None = None) -> tuple[int, dict[int, int]]:
        """(version, bucket -> batch whose folder holds it) of the last version, or of the last one below a number."""
        versions = spark.read.schema(f"{_LIVE}, version bigint").parquet(f"{self.folder}/versions")
        if below is not None:
            versions = versions.where(F.col("version") < below)
        rows = versions.where(F.col("version") == versions.agg(F.max("version").alias("v")).scalar()).collect()
        return max((r.version for r in rows), default=-1), {r.bucket: r.batch for r in rows}

    def _read(self, spark: SparkSession, live: dict[int, int]) -> DataFrame:
        """Rows of live buckets; their folders are chosen by partition filters."""
        if not live:
            return spark.createDataFrame([], self.schema)
        wanted = F.lit(False)
        for batch in sorted(set(live.values())):
            wanted = wanted | ((F.col("batch") == batch) & F.col("bucket").isin([b for b, k in live.items() if k == batch]))
        rows = spark.read.schema(f"{self.schema}, batch bigint, bucket int").parquet(f"{self.folder}/data")
        return rows.where(wanted).drop("batch", "bucket")

    def current(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """One row for each key, as of the last version or of an earlier one."""
        return self._read(spark, self._live(spark, None if version is None else version + 1)[1])

    def merge(self, rows: DataFrame, version: int) -> None:
        """Upsert a batch as this version. Rows without a key are left out; merging the last version again changes nothing."""
        spark = rows.sparkSession
        last, _ = self._live(spark)
        if last > version:
            raise ValueError(f"version {last} is there already; batch {version} belongs to another checkpoint.")
        _, live = self._live(spark, version)
        names = spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        newest = shared_table(latest_per_key(rows.select(*names).where(F.col(self.key).isNotNull()), [self.key], self.order).select(*names))
        touched = [r.bucket for r in newest.select(bucket.alias("bucket")).distinct().collect()]
        before = self._read(spark, {b: k for b, k in live.items() if b in touched})
        merged = latest_per_key(before.unionByName(newest), [self.key], self.order).select(*names, bucket.alias("bucket"))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={version}")
        self._write_live(spark, live | dict.fromkeys(touched, version), version)

    def stream(self, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer that merges each micro-batch under its number: exactly once, also after a restart from the checkpoint."""
        return rows.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
