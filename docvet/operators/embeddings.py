"""Chunk and query embedding records, with a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions import vectors as V
from docvet.functions.ids import canonical_hash
from docvet.functions.text import let


@dataclass(frozen=True)
class EmbeddingProvider:
    """Configuration plus an optional column function (usually an Arrow pandas_udf).

    Without ``embed`` the built-in hash embedding is used, which stays in the JVM.
    """

    provider: str = V.PROVIDER
    model_name: str = V.MODEL_NAME
    dimensions: int = V.DIMENSIONS
    normalize: bool = True
    include_heading_context: bool = True
    strategy_version: str = V.STRATEGY_VERSION
    embed: Callable[[Column], Column] | None = None

    def vector(self, text: Column) -> Column:
        if self.embed is None:
            return V.hash_embedding(text, self.model_name, self.dimensions, self.normalize)
        value = self.embed(text)
        return F.when(F.size(value) == self.dimensions, value).otherwise(
            F.raise_error(F.lit("embedding vector length must match configured dimensions.")).cast("array<double>")
        )

    def config_columns(self) -> list[Column]:
        return [
            F.lit(self.provider).alias("provider"), F.lit(self.model_name).alias("model_name"),
            F.lit(self.dimensions).alias("dimensions"), F.lit(self.normalize).alias("normalize"),
            F.lit(self.strategy_version).alias("strategy_version"),
        ]


def embedding_input(provider: EmbeddingProvider) -> Column:
    """Path, heading trail and text of a chunk, one per line; empty context parts are left out."""
    if not provider.include_heading_context:
        return F.col("text")
    trail = F.array_join("heading_path", " > ")
    context = F.filter(F.array(F.coalesce("path", F.lit("")), trail), lambda p: p != "")
    return F.array_join(F.concat(context, F.array("text")), "\n")


CONFIG_NAMES = ("provider", "model_name", "dimensions", "normalize", "strategy_version")
RECORD_KEYS = ("chunk_id", "artifact_id", "path", "chunk_index", "start_line", "end_line", "heading_path")


def record_columns(provider: EmbeddingProvider, vector: Column, has_metadata: bool) -> list[Column]:
    """Columns of a chunk's record: keys, configuration and vector."""
    metadata = ["metadata_hash"] if has_metadata else []
    return [*(F.col(c) for c in (*RECORD_KEYS, "content_hash", *metadata)), *provider.config_columns(), vector.alias("vector")]


def record_hash(provider: EmbeddingProvider, vector: Column, has_metadata: bool) -> Column:
    """Hash of a chunk's record; ``chunk_embeddings`` gives the same for the same vector."""
    record = F.struct(*record_columns(provider, vector, has_metadata))
    names = [*RECORD_KEYS, "content_hash", *(["metadata_hash"] if has_metadata else []), *CONFIG_NAMES, "vector"]
    return let(record, lambda r: F.sha2(F.to_json(F.struct(*[r[n].alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"}), 256))


def chunk_embeddings(chunks: DataFrame, provider: EmbeddingProvider = EmbeddingProvider()) -> DataFrame:
    """One record per chunk: keys, configuration, vector and its hash; no text."""
    columns = record_columns(provider, provider.vector(embedding_input(provider)), "metadata_hash" in chunks.columns)
    rows = chunks.select(*columns)
    return rows.withColumn("embedding_hash", canonical_hash(*rows.columns))


def query_embeddings(queries: DataFrame, provider: EmbeddingProvider = EmbeddingProvider()) -> DataFrame:
    """``queries(query_id, query)`` -> hash, configuration and vector; the text is not kept."""
    rows = queries.select(
        "query_id", F.sha2("query", 256).alias("query_hash"), *provider.config_columns(),
        provider.vector(F.col("query")).alias("vector"),
    )
    hashed = [c for c in rows.columns if c != "query_id"]
    return rows.withColumn("embedding_hash", canonical_hash(*hashed))
