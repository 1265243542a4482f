"""Typed tool-risk graph: ids, integrity, adjacency, the six graph queries, features, traversals.

``nodes(node_id, node_type, label, source_id, metadata MAP<STRING,STRING>, + attribute columns)`` and
``edges(edge_id, edge_type, source_node_id, source_node_type, target_node_id, target_node_type, ...)``.
Metadata values are JSON-encoded (true, 3, text). Filters on node and edge type come before joins,
existence questions are semi joins, and counts fold map-side, so one very connected node only
costs partial rows.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docvet.functions.ids import typed_id
from docvet.functions.numbers import json_change_count, json_number
from docvet.functions.text import contains_any, is_blank, map_text
from docvet.session import ensure_checkpoint_dir, reliable_checkpoint, shared_table

# Node and edge types, marker lists, thresholds.
NODE_TYPES = (
    "source_repo", "artifact", "evidence_span", "tool", "parameter", "capability", "env_var", "external_domain",
    "dependency", "maintainer", "finding", "policy_rule", "scan_run", "sandbox_task", "unsafe_action",
)
EDGE_SPECS = {
    "has_artifact": ("source_repo", "artifact"),
    "defines": ("artifact", "tool"),
    "has_parameter": ("tool", "parameter"),
    "requires": ("tool", "capability"),
    "mentions": ("tool", "env_var"),
    "calls": ("tool", "external_domain"),
    "depends_on": ("tool", "dependency"),
    "contains": ("artifact", "evidence_span"),
    "triggers": ("evidence_span", "finding"),
    "violates": ("finding", "policy_rule"),
    "observed": ("scan_run", "finding"),
    "used": ("sandbox_task", "tool"),
    "produced": ("sandbox_task", "unsafe_action"),
}
INSTRUCTION_MARKERS = (
    "ignore previous", "ignore all previous", "system prompt", "developer message", "follow these instructions",
    "secret instructions", "do not reveal", "prompt injection",
)
CREDENTIAL_MARKERS = ("api_key", "apikey", "credential", "password", "secret", "token")
ABANDONED_MARKERS = ("abandoned", "deprecated", "unmaintained")
SUSPICIOUS_MARKERS = ("suspicious", "prompt_injection", "prompt injection", "instruction")
HIGH_RISK_DEPENDENCY_MARKERS = ("abandoned", "deprecated", "malicious", "unmaintained", "vulnerable")
CHANGE_KEYS = ("recent_metadata_changes", "metadata_changes", "metadata_change_count", "recent_change_count")
HIGH_SEVERITIES = ("high", "critical")


def node_id(node_type: Column, raw_id: Column) -> Column:
    return typed_id(node_type, raw_id)


def node_key(node_type: str, raw_id: str) -> str:
    """The id of one node as a plain string, for filters that are to reach the storage."""
    return f"{node_type}_{hashlib.sha256(f'{node_type}:{raw_id}'.encode()).hexdigest()[:16]}"


def edge_id(edge_type: Column, source: Column, target: Column) -> Column:
    return typed_id(edge_type, source, target)


def edge_type_violations(edges: DataFrame) -> DataFrame:
    """Edges that do not join the one node-type pair allowed for their type."""
    expected = F.lit(None).cast("string")
    for name, (source, target) in EDGE_SPECS.items():
        expected = F.when(F.col("edge_type") == name, f"{source}>{target}").otherwise(expected)
    actual = F.concat_ws(">", "source_node_type", "target_node_type")
    return edges.where(~actual.eqNullSafe(expected)).select(
        "edge_id", "edge_type", actual.alias("found"),
        F.coalesce(expected, F.lit("unknown edge type")).alias("expected"),
    )


def integrity_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate node ids, blank ids or labels, unknown types, and edges with a missing endpoint."""
    duplicates = nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("node_id").alias("item_id"), F.lit("duplicate_node").alias("problem")
    )
    bad = F.array_compact(F.array(
        F.when(is_blank(F.col("node_id")) | is_blank(F.col("label")), F.lit("blank_node")),
        F.when(~F.col("node_type").isin(*NODE_TYPES), F.lit("unknown_node_type")),
    ))
    node_problems = nodes.select(F.col("node_id").alias("item_id"), F.explode(bad).alias("problem"))
    known = nodes.select("node_id").where("node_id IS NOT NULL").distinct()
    # Ends are settled as ids, each once, so that edges themselves don't move: only ids without a node meet them again.
    ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct()
    absent = shared_table(ends.join(known, "node_id", "left_anti"))
    end = lambda name: F.struct(F.col(f"{name}_node_id").alias("end"), F.lit(f"missing_{name}").alias("problem"))
    both = edges.select(F.col("edge_id").alias("item_id"), F.inline(F.array(end("source"), end("target"))))
    missing = both.join(absent, both["end"].eqNullSafe(absent["node_id"]), "left_semi").select("item_id", "problem")
    return duplicates.unionByName(node_problems).unionByName(missing)


def _of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def _edges_of(edges: DataFrame, edge_type: str | None) -> DataFrame:
    rows = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    return rows.select("edge_type", "source_node_id", "target_node_id")


def target_nodes(nodes: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Each edge source with the node it points to (one row per edge)."""
    return _edges_of(edges, edge_type).join(
        nodes, F.col("target_node_id") == nodes["node_id"]
    ).withColumnRenamed("source_node_id", "from_node_id").drop("target_node_id")


def source_nodes(nodes: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Each edge target with the node that points to it (one row per edge)."""
    return _edges_of(edges, edge_type).join(
        nodes, F.col("source_node_id") == nodes["node_id"]
    ).withColumnRenamed("target_node_id", "to_node_id").drop("source_node_id")


def neighbourhood(edges: DataFrame, node: str, in_edges: DataFrame | None = None) -> DataFrame:
    """One-hop neighbours of a node in either direction.

    ``in_edges`` are the same edges stored by target: then each side reads the one bucket of the node.
    """
    out = edges.where(F.col("source_node_id") == node).select("edge_type", F.lit("out").alias("direction"), F.col("target_node_id").alias("node_id"))
    by_target = edges if in_edges is None else in_edges
    incoming = by_target.where(F.col("target_node_id") == node).select("edge_type", F.lit("in").alias("direction"), F.col("source_node_id").alias("node_id"))
    return out.unionByName(incoming)


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every node that has an edge."""
    ends = F.array(
        F.struct(F.col("source_node_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target_node_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return edges.select(F.inline(ends)).groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _tools_with(nodes: DataFrame, edges: DataFrame, edge_type: str, node_type: str, test: Column) -> DataFrame:
    """Ids of tools with an edge to a node that passes ``test`` (tested before the join)."""
    wanted = _of_type(nodes, node_type).where(test).select("node_id")
    return _edges_of(edges, edge_type).join(wanted, F.col("target_node_id") == wanted["node_id"], "left_semi").select(
        F.col("source_node_id").alias("node_id")
    )


def in_label_order(nodes: DataFrame) -> DataFrame:
    """Result nodes as they are listed: by label, then id; a range-partitioned sort."""
    return nodes.orderBy("label", "node_id")


def in_tool_order(changes: DataFrame) -> DataFrame:
    """Permission changes as they are listed: by tool name and id, added ones first."""
    return changes.orderBy("tool_name", "tool_id", "change", "capability_id")


def network_tools_with_credentials(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    network = F.lower(F.concat_ws(" ", "raw_id", "name")).contains("network")
    credential = F.coalesce("sensitive", F.lit(False)) | contains_any(
        F.concat_ws(" ", "name", map_text(F.col("metadata"))), CREDENTIAL_MARKERS
    )
    tools = _of_type(nodes, "tool")
    tools = tools.join(_tools_with(nodes, edges, "requires", "capability", network), "node_id", "left_semi")
    return tools.join(_tools_with(nodes, edges, "mentions", "env_var", credential), "node_id", "left_semi")


def repos_with_instruction_like_tools(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "name", "description", map_text(F.col("metadata")))
    suspects = _of_type(nodes, "tool").where(contains_any(text, INSTRUCTION_MARKERS)).select("node_id")
    defines = _edges_of(edges, "defines").join(suspects, F.col("target_node_id") == suspects["node_id"], "left_semi")
    artifacts = defines.select(F.col("source_node_id").alias("artifact_node")).distinct()
    owned = _edges_of(edges, "has_artifact").join(artifacts, F.col("target_node_id") == F.col("artifact_node"), "left_semi")
    repos = owned.select(F.col("source_node_id").alias("node_id")).distinct()
    return _of_type(nodes, "source_repo").join(repos, "node_id", "left_semi")


def permission_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Capabilities added or removed per tool between two snapshots: (tool_id, tool_name, capability_id), a null capability for tools that have none.

    A set difference on (tool, capability) rows, so no per-tool set is collected to compare. Tools
    missing from the previous snapshot are not compared.
    """
    common = previous.select("tool_id").distinct()
    now = current.join(common, "tool_id", "left_semi")
    still_there = current.select("tool_id", "tool_name").distinct()
    before = previous.drop("tool_name").join(still_there, "tool_id")
    both = (
        now.where(F.col("capability_id").isNotNull()).select("tool_id", "tool_name", "capability_id", F.lit(1).alias("side"))
        .unionByName(before.where(F.col("capability_id").isNotNull()).select("tool_id", "tool_name", "capability_id", F.lit(-1).alias("side")))
    )
    delta = both.groupBy("tool_id", "tool_name", "capability_id").agg(F.sum("side").alias("side")).where("side <> 0")
    return delta.select(
        "tool_id", "tool_name", "capability_id", F.when(F.col("side") > 0, "added").otherwise("removed").alias("change")
    )


def high_risk_tools_with_abandoned_dependencies(nodes: DataFrame, edges: DataFrame, risk_weight_threshold: int = 3) -> DataFrame:
    abandoned = contains_any(map_text(F.col("metadata")), ABANDONED_MARKERS)
    tools = _of_type(nodes, "tool")
    risky = _tools_with(nodes, edges, "requires", "capability", F.col("risk_weight") >= risk_weight_threshold)
    return tools.join(risky, "node_id", "left_semi").join(
        _tools_with(nodes, edges, "depends_on", "dependency", abandoned), "node_id", "left_semi"
    )


def low_static_high_sandbox_tools(
    nodes: DataFrame, edges: DataFrame, static_risk_threshold: float = 40.0, high_severities=HIGH_SEVERITIES
) -> DataFrame:
    score = json_number(F.col("metadata")["static_risk_score"])
    tools = _of_type(nodes, "tool").where(score <= static_risk_threshold)
    severe = _of_type(nodes, "unsafe_action").where(F.lower("severity").isin(*[s.lower() for s in high_severities])).select("node_id")
    tasks = _edges_of(edges, "produced").join(severe, F.col("target_node_id") == severe["node_id"], "left_semi").select(
        F.col("source_node_id").alias("task")
    ).distinct()
    used = _edges_of(edges, "used").join(tasks, F.col("source_node_id") == F.col("task"), "left_semi").select(
        F.col("target_node_id").alias("node_id")
    )
    return tools.join(used, "node_id", "left_semi")


def evidence_for_quarantine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    findings = _of_type(nodes, "finding")
    by_metadata = findings.where(F.lower(F.col("metadata")["policy_decision"]) == "quarantine").select("node_id")
    rules = _of_type(nodes, "policy_rule").where(F.lower("action") == "quarantine").select("node_id")
    by_rule = _edges_of(edges, "violates").join(rules, F.col("target_node_id") == rules["node_id"], "left_semi").select(
        F.col("source_node_id").alias("node_id")
    )
    flagged = by_metadata.unionByName(by_rule).distinct().withColumnRenamed("node_id", "finding_node")
    spans = _edges_of(edges, "triggers").join(flagged, F.col("target_node_id") == F.col("finding_node"), "left_semi").select(
        F.col("source_node_id").alias("node_id")
    ).distinct()
    return _of_type(nodes, "evidence_span").join(spans, "node_id", "left_semi")


def spans_of_tools(edges: DataFrame, tools: DataFrame) -> DataFrame:
    """Evidence spans of the asked-for tools, through the artifacts that define them."""
    asked = tools.select(F.col("node_id").alias("tool")).distinct()
    defines = _edges_of(edges, "defines").select(F.col("source_node_id").alias("artifact"), F.col("target_node_id").alias("tool"))
    contains = _edges_of(edges, "contains").select(F.col("source_node_id").alias("artifact"), F.col("target_node_id").alias("span"))
    return defines.join(asked, "tool").join(contains, "artifact").select("tool", "span")


def span_counts_of_tools(edges: DataFrame) -> DataFrame:
    """Evidence spans per tool: counted per artifact first, then summed over its artifacts."""
    spans = _edges_of(edges, "contains").groupBy(F.col("source_node_id").alias("artifact")).agg(F.count("*").alias("spans"))
    defines = _edges_of(edges, "defines").select(F.col("source_node_id").alias("artifact"), F.col("target_node_id").alias("node_id"))
    return defines.join(spans, "artifact").groupBy("node_id").agg(F.sum("spans").alias("span_count"))


def _artifact_findings(nodes: DataFrame, out_edges: DataFrame, in_edges: DataFrame) -> DataFrame:
    """(artifact, finding_id or null, suspicious): every finding of an artifact once, and whether its spans or findings are suspicious.

    Settled per artifact before tools come in, so spans are never multiplied by tools. Findings meet their ``triggers`` and spans
    their ``contains`` by the bucketed target; only span ids are shuffled to bring the two together.
    """
    findings = _of_type(nodes, "finding").select(
        F.col("node_id").alias("target_node_id"), F.col("raw_id").alias("finding_id"),
        contains_any(F.concat_ws(" ", "finding_type", "severity", map_text(F.col("metadata"))), SUSPICIOUS_MARKERS).alias("finding_hit"),
    )
    triggered = _edges_of(in_edges, "triggers").join(findings, "target_node_id").select(F.col("source_node_id").alias("span"), "finding_id", "finding_hit")
    spans = _of_type(nodes, "evidence_span").select(
        F.col("node_id").alias("target_node_id"),
        ((F.lower(F.col("metadata")["suspicious"]) == "true").eqNullSafe(True)
         | contains_any(F.concat_ws(" ", "span_type", "label", map_text(F.col("metadata"))), SUSPICIOUS_MARKERS)).alias("span_hit"),
    )
    held = _edges_of(in_edges, "contains").join(spans, "target_node_id").select(F.col("source_node_id").alias("artifact"), F.col("target_node_id").alias("span"), "span_hit")
    hit = F.col("span_hit") | F.coalesce("finding_hit", F.lit(False))
    return held.join(triggered, "span", "left").groupBy("artifact", "finding_id").agg(F.bool_or(hit).alias("suspicious"))


def tool_risk_features(
    nodes: DataFrame, edges: DataFrame, high_risk_dependency_score: float = 70.0, in_edges: DataFrame | None = None
) -> DataFrame:
    """The seven risk features of every tool; tools without edges get zeros and a null distance.

    Every edge becomes a row (tool, feature, value, n, near), so that one aggregation counts distinct values and sums for all of them; features
    are numbers there, as the rows are many. A finding that one artifact alone has is counted there, and its number is one row for each tool of the
    artifact, which also says whether a suspicious span is near; only findings that artifacts share are paired with tools. ``in_edges`` are the
    same edges stored by target.
    """
    c, feature_of = F.col, {name: F.lit(i).cast("tinyint") for i, name in enumerate(("external_domain", "env_var", "capability", "dependency", "own", "finding"))}
    in_edges = edges if in_edges is None else in_edges
    dependency_hit = (
        (F.lower(c("metadata")["high_risk"]) == "true").eqNullSafe(True)
        | F.coalesce(json_number(c("metadata")["risk_score"]) >= high_risk_dependency_score, F.lit(False))
        | contains_any(F.concat_ws(" ", "name", map_text(c("metadata"))), HIGH_RISK_DEPENDENCY_MARKERS)
    )
    kind = c("node_type")
    value = (
        F.when(kind == "external_domain", c("domain")).when(kind == "capability", c("raw_id"))
        .when((kind == "env_var") & F.coalesce("sensitive", F.lit(False)), F.lit("")).when((kind == "dependency") & dependency_hit, F.lit(""))
    )
    feature = F.coalesce(*[F.when(kind == name, code) for name, code in feature_of.items()])
    targets = nodes.where(kind.isin("external_domain", "env_var", "capability", "dependency")).select(c("node_id").alias("target_node_id"), feature.alias("feature"), value.alias("value"))
    targets = targets.where("value IS NOT NULL")
    wanted = in_edges.where(c("edge_type").isin("calls", "mentions", "requires", "depends_on")).select("source_node_id", "target_node_id")
    once, far = F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("near")
    direct = wanted.join(targets, "target_node_id").select(c("source_node_id").alias("node_id"), "feature", "value", once, far)

    found = shared_table(_artifact_findings(nodes, edges, in_edges))  # three aggregates read it
    homes = found.where("finding_id IS NOT NULL").groupBy("finding_id").agg(F.count("*").alias("artifacts"), F.min("artifact").alias("artifact"))
    facts = homes.where("artifacts = 1").select("artifact", F.lit(1).alias("own"), F.lit(False).alias("suspicious")).unionByName(
        found.select("artifact", F.lit(0).alias("own"), "suspicious")
    ).groupBy("artifact").agg(F.sum("own").alias("own"), F.bool_or("suspicious").alias("suspicious"))
    shared = found.join(homes.where("artifacts > 1").select("finding_id"), "finding_id", "left_semi").select("artifact", "finding_id")
    defines = _edges_of(edges, "defines").select(c("source_node_id").alias("artifact"), c("target_node_id").alias("node_id"))
    # A span and a tool of the same artifact are two steps apart and no edge type joins them directly.
    through = defines.join(facts, "artifact").select("node_id", feature_of["own"].alias("feature"), c("artifact").alias("value"), c("own").alias("n"), c("suspicious").alias("near"))
    paired = defines.join(shared, "artifact").select("node_id", feature_of["finding"].alias("feature"), c("finding_id").alias("value"), once, far)

    # Rows are hardly ever equal, so they are dealt as they are: summing them first would hold all rows of a task that reads many edges.
    dealt = direct.union(through).union(paired).repartition("node_id", "feature", "value")
    values = dealt.groupBy("node_id", "feature", "value").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("near").alias("near"))
    is_ = lambda name: c("feature") == feature_of[name]
    total = lambda name, column: F.coalesce(F.sum(F.when(is_(name), c(column))), F.lit(0).cast("bigint"))
    counted = values.groupBy("node_id").agg(
        F.count_if(is_("external_domain")).alias("external_communication_degree"), total("env_var", "n").alias("sensitive_env_var_count"),
        F.count_if(is_("capability")).alias("permission_count"), total("dependency", "n").alias("high_risk_dependency_count"),
        F.max(F.when(is_("own") & c("near"), F.lit(2))).alias("distance"),
        (total("own", "most") + F.count_if(is_("finding"))).alias("independent_finding_count"),
    )
    metadata = c("metadata")
    change_value = F.lit(None).cast("string")
    for key in reversed(CHANGE_KEYS):
        change_value = F.when(F.map_contains_key(metadata, key), metadata[key]).otherwise(change_value)
    tools = _of_type(nodes, "tool").select(
        "node_id", c("raw_id").alias("tool_id"), c("name").alias("tool_name"),
        F.coalesce(json_change_count(change_value), F.lit(0)).alias("recent_metadata_change_count"),
    )
    joined = tools.join(counted, "node_id", "left")
    zero = F.lit(0)
    return joined.select(
        c("node_id").alias("tool_node_id"), "tool_id", "tool_name",
        *[F.coalesce(n, zero).alias(n) for n in (
            "external_communication_degree", "sensitive_env_var_count", "permission_count", "high_risk_dependency_count")],
        c("distance").alias("suspicious_span_to_tool_description_distance"),
        "recent_metadata_change_count",
        F.coalesce("independent_finding_count", zero).alias("independent_finding_count"),
    )


def _rounds(spark, start: DataFrame, step, key: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """Breadth-first search: (key, distance) of all that ``step`` reaches from ``start``, until a round finds nothing new.

    Each round is written as a folder of its own beside the others, so that the settled nodes are always one table,
    the plan doesn't grow with the depth, and a lost executor restarts no search.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/search_{uuid.uuid4().hex}"
    frontier = start.select(*key).dropna().distinct()
    schema = T.StructType([*frontier.schema, T.StructField("distance", T.IntegerType())])
    depth = 0
    while True:
        frontier.write.parquet(f"{folder}/distance={depth}")
        settled = spark.read.schema(schema).option("basePath", folder).parquet(folder)
        last = settled.where(F.col("distance") == depth)
        if last.isEmpty():
            return settled
        frontier = step(last.select(*key)).distinct().join(settled.select(*key), list(key), "left_anti")
        depth += 1


def nearest_distances(edges: DataFrame, starts: DataFrame, in_edges: DataFrame | None = None, key: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(key, distance): undirected steps from each reachable node to the nearest of ``starts``, of any depth.

    ``key`` names a node's columns; an edge has them as ``source_`` and ``target_``. Edges stored by source and by target meet the
    frontier without being shuffled.
    """
    by_target = edges if in_edges is None else in_edges

    def met(rows: DataFrame, frontier: DataFrame, here: str, there: str) -> DataFrame:
        at = reduce(and_, (F.col(f"{here}_{k}") == F.col(k) for k in key))
        return rows.join(frontier, at, "left_semi").select(*[F.col(f"{there}_{k}").alias(k) for k in key])

    def step(frontier: DataFrame) -> DataFrame:
        return met(edges, frontier, "source", "target").unionByName(met(by_target, frontier, "target", "source"))

    return _rounds(edges.sparkSession, starts, step, key)


def undirected_distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Shortest undirected distance from each start node to every reachable node (breadth first).

    One frontier join per level. Each level is checkpointed to the shared folder, so lineage stays
    flat and a lost executor does not restart the search.
    """
    both_ways = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"))
    both_ways = both_ways.unionByName(both_ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = reliable_checkpoint(starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("distance")).distinct())
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(both_ways, frontier["node_id"] == both_ways["a"]).select("start", F.col("b").alias("node_id")).distinct()
        frontier = reliable_checkpoint(
            step.join(seen, ["start", "node_id"], "left_anti").withColumn("distance", F.lit(depth))
        )
        seen = seen.unionByName(frontier)
    return seen


def upstream_edge_types(node_type: str) -> tuple[str, ...]:
    """The edge types by which anything lies upstream of a node of a type, as EDGE_SPECS joins types."""
    reached, found = {node_type}, set()
    while new := {e for e, (_, target) in EDGE_SPECS.items() if target in reached} - found:
        found |= new
        reached |= {EDGE_SPECS[e][0] for e in new}
    return tuple(sorted(found))


def upstream_of_findings(nodes: DataFrame, edges: DataFrame, severity: str, in_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of a severity, everything upstream of them, and the edges in between."""
    by_target = edges if in_edges is None else in_edges

    def step(frontier: DataFrame) -> DataFrame:
        return by_target.join(frontier, F.col("target_node_id") == F.col("node_id"), "left_semi").select(F.col("source_node_id").alias("node_id"))

    visited = _rounds(nodes.sparkSession, _of_type(nodes, "finding").where(F.col("severity") == severity), step).select("node_id")
    kept_nodes = nodes.join(visited, "node_id", "left_semi")
    ends = visited.withColumnRenamed("node_id", "end")
    kept_edges = edges.join(ends, F.col("source_node_id") == F.col("end"), "left_semi").join(
        ends, F.col("target_node_id") == F.col("end"), "left_semi"
    )
    return kept_nodes, kept_edges
