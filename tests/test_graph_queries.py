"""Graph queries over derived tables: no stored copy of the whole graph, and the tool that a neighbourhood starts from."""

import os

import pytest

from docvet.operators import graph as G
from docvet.plans import graph_inputs, risk_queries as R

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_store(monkeypatch):
    def refuse(*_):
        raise AssertionError("the whole graph is written")

    for module in (graph_inputs, R):
        monkeypatch.setattr(module, "stored_graph", refuse)
    monkeypatch.setattr(graph_inputs, "write_graph", refuse)


@pytest.mark.parametrize("name", [
    "c19_span_counts", "h2_upstream_closure", "d12_final_actions", "c7_abandoned_dependencies", "h3_neighbourhood", "b37_policy_operators",
    "b41_policy_explanations", "c10_graph_integrity", "b31_edge_spec_violations",
])
def test_one_pass_queries_store_no_graph(spark, no_store, name):
    assert R.QUERIES[name][0](spark, SF).count() > 0


def test_neighbourhood_starts_from_the_least_part_key(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "part.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    spark.read.parquet(f"{SF}/part.parquet").where("p_partkey > 8").write.parquet(str(tmp_path / "part.parquet"))
    rows = [(r.edge_type, r.direction, r.raw_id) for r in R.neighbourhood_query(spark, str(tmp_path)).collect()]
    assert ("has_parameter", "out", "par_9") in rows and sum(t == "requires" for t, _, _ in rows) == 2
    assert any(t == "used" and d == "in" for t, d, _ in rows)


def test_missing_ends_of_null_and_repeated_ids(spark):
    nodes = spark.createDataFrame([("a", "tool", "x"), ("b", "tool", "x"), ("b", "tool", "x"), (None, "tool", "x")], "node_id string, node_type string, label string")
    edges = spark.createDataFrame(
        [("e1", "a", "b"), ("e2", "a", "gone"), ("e2", "a", "gone"), ("e3", None, "a"), ("e4", "gone", "gone")], "edge_id string, source_node_id string, target_node_id string"
    )
    found = sorted((str(r.item_id), r.problem) for r in G.integrity_violations(nodes, edges).collect())
    # A null id is no node that an edge could end in.
    assert found == sorted([("b", "duplicate_node"), ("e2", "missing_target"), ("e2", "missing_target"), ("e3", "missing_source"), ("e4", "missing_source"), ("e4", "missing_target")])


def test_upstream_types_follow_the_specs():
    assert G.upstream_edge_types("finding") == ("contains", "has_artifact", "observed", "triggers")
    assert G.upstream_edge_types("source_repo") == ()


def test_upstream_search_reads_derived_edges(spark, monkeypatch):
    seen, search = [], G.upstream_of_findings

    def watch(nodes, edges, *more):
        seen.append(edges._jdf.queryExecution().executedPlan().toString())
        return search(nodes, edges, *more)

    monkeypatch.setattr(G, "upstream_of_findings", watch)
    assert R.upstream_query(spark, SF).count() > 0
    assert len(seen) == 1 and "Exchange" not in seen[0] and "edge_id" in seen[0]  # no round derives the edges again


def test_features_move_short_ids_and_equal_those_of_hashed_ids(spark):
    rows = R.features(spark, SF)
    assert "sha2" not in rows._jdf.queryExecution().executedPlan().toString()
    want = G.tool_risk_features(*graph_inputs.graph(spark, SF, R.FEATURE_NODES, R.FEATURE_EDGES)).drop("tool_node_id")
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))


def test_feature_rows_are_dealt_before_they_are_summed(spark):
    plan = R.features(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [node_id" in plan
