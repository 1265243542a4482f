"""A stored graph: node and edge tables partitioned by type and bucketed by id.

Filters on a type read its folders only, a filter on one id reads its bucket only, and joins on the bucketed id need no
shuffle. Edges are stored twice, by source and by target. A node with very many edges lies in one bucket: its rows
are streamed by one task, while everything else is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from docvet.session import shared_table
from docvet.sources.bucketed import bucketed_table, buckets_for

#: Edges of a bucket, about.
BUCKET_EDGES = 2_000_000


@dataclass(frozen=True)
class StoredGraph:
    """``nodes`` by their key, ``out_edges`` by that of the source, ``in_edges`` by that of the target: the same edges twice."""

    nodes: DataFrame
    out_edges: DataFrame
    in_edges: DataFrame
    buckets: int


def write_graph(nodes: DataFrame, edges: DataFrame, buckets: int | None = None, key: tuple[str, ...] = ("node_id",)) -> StoredGraph:
    """Write a graph into the shared folder; ``buckets`` follows the number of edges unless given, which takes one more writing of them.

    ``key`` names a node's columns; an edge has them as ``source_`` and ``target_``. The edges by target are read off those by source.
    """
    if buckets is None:
        edges = shared_table(edges)
        buckets = buckets_for(edges.count(), BUCKET_EDGES)
    kind = lambda df, name: name if name in df.columns else None
    by_source = bucketed_table(edges, tuple(f"source_{k}" for k in key), buckets, kind(edges, "edge_type"))
    by_target = bucketed_table(by_source, tuple(f"target_{k}" for k in key), buckets, kind(edges, "edge_type"))
    return StoredGraph(bucketed_table(nodes, key, buckets, "node_type"), by_source, by_target, buckets)
