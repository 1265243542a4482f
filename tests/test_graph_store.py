"""The stored graph: the same answers as plain tables, buckets that filters and joins use, and searches of any depth."""

import random
import re
from collections import deque

import pytest

from pyspark.sql import functions as F

from docvet.operators import graph as G
from docvet.plans import graph_inputs
from docvet.plans.graph_inputs import edges, nodes
from docvet.sources.graph_store import write_graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    return nodes(spark, SF).persist(), edges(spark, SF).persist()


@pytest.fixture(scope="module")
def stored(plain):
    return write_graph(*plain, buckets=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    order = sorted(a.columns)
    return sorted(map(str, a.select(*order).drop("metadata").collect())) == sorted(map(str, b.select(*order).drop("metadata").collect()))


def test_tables_hold_the_graph(plain, stored):
    assert same(stored.nodes, plain[0]) and same(stored.out_edges, plain[1]) and same(stored.in_edges, plain[1])


def test_one_node_reads_one_bucket(spark, plain, stored):
    node = G.node_key("tool", "t3")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else files are pruned, but the plan doesn't say so
    try:
        around = G.neighbourhood(stored.out_edges, node, stored.in_edges)
        assert re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan(around)) == [("1", "4")] * 2
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert same(around, G.neighbourhood(plain[1], node)) and around.count() > 3


def test_a_type_reads_its_folder_and_joins_on_the_bucketed_id_do_not_shuffle(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        calls = stored.in_edges.where("edge_type = 'calls'").join(stored.nodes.where("node_type = 'external_domain'"), stored.in_edges["target_node_id"] == stored.nodes["node_id"])
        assert "Exchange" not in plan(calls) and "PartitionFilters: [isnotnull(edge_type" in plan(calls) and calls.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_features_and_closure_are_those_of_plain_tables(plain, stored):
    assert same(G.tool_risk_features(stored.nodes, stored.out_edges, in_edges=stored.in_edges), G.tool_risk_features(*plain))
    for a, b in zip(G.upstream_of_findings(stored.nodes, stored.out_edges, "critical", stored.in_edges), G.upstream_of_findings(*plain, "critical")):
        assert same(a, b)


def test_repeated_edges_count_once_where_values_are_distinct(spark, plain):
    twice = plain[1].where("edge_type IN ('defines', 'contains', 'triggers', 'requires', 'calls')")
    want = {r.tool_id: r for r in G.tool_risk_features(*plain).collect()}
    got = {r.tool_id: r for r in G.tool_risk_features(plain[0], plain[1].unionByName(twice)).collect()}
    assert got == want


def test_nearest_distances_equal_a_plain_search(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(160)} | {(f"c{k}", f"c{k + 1}") for k in range(25)} | {("hub", f"n{k}") for k in range(0, 150, 40)}
    frame = spark.createDataFrame([("calls", a, b) for a, b in pairs], "edge_type string, source_node_id string, target_node_id string")
    starts = ["n3", "n77", "c0", "alone", "n3", None]
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    want, queue = {s: 0 for s in starts if s}, deque(s for s in starts if s)
    while queue:
        x = queue.popleft()
        for y in around.get(x, ()):
            if y not in want:
                want[y] = want[x] + 1
                queue.append(y)
    got = G.nearest_distances(frame, spark.createDataFrame([(s,) for s in starts], "node_id string")).collect()
    assert {r.node_id: r.distance for r in got} == want and len(got) == len(want) and max(want.values()) >= 25


def test_empty_starts(spark, plain):
    assert G.nearest_distances(plain[1], plain[0].where("false")).collect() == []


def test_search_graph_is_keyed_by_numbers_one_to_one_with_ids(spark, plain):
    g = graph_inputs.stored_graph(spark, SF)
    assert {t for _, t in g.out_edges.dtypes + g.in_edges.dtypes} == {"tinyint", "bigint"}  # no id of 16 digits is moved or stored
    keyed = plain[0].select("node_id", *graph_inputs._numbers(F.col("node_type"), F.col("raw_id"))).distinct()
    assert keyed.count() == keyed.select("node_id").distinct().count() == keyed.select(*graph_inputs.NUMBERS).distinct().count()
    end = lambda side: keyed.select(F.col("node_id").alias(f"{side}_node_id"), *[F.col(n).alias(f"{side}_{n}") for n in graph_inputs.NUMBERS])
    names = [f"{side}_{n}" for side in ("source", "target") for n in graph_inputs.NUMBERS]
    want = plain[1].join(end("source"), "source_node_id").join(end("target"), "target_node_id").select(*names)
    assert same(g.out_edges.select(*names), want) and same(g.in_edges.select(*names), want)


def test_search_by_two_key_columns_equals_that_by_ids(spark):
    pairs = [("tool", 1, "task", 1), ("task", 1, "tool", 2), ("tool", 2, "artifact", 9), ("artifact", 1, "tool", 7)]
    two = spark.createDataFrame(pairs, "source_kind string, source_no bigint, target_kind string, target_no bigint")
    starts = spark.createDataFrame([("tool", 1), ("tool", 1), ("tool", None)], "kind string, no bigint")
    found = G.nearest_distances(two, starts, key=("kind", "no")).collect()
    assert sorted(map(tuple, found)) == [("artifact", 9, 3), ("task", 1, 1), ("tool", 1, 0), ("tool", 2, 2)]
