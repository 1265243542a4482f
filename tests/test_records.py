"""Nested policy contexts against a plain lookup, and checks of every record kind."""

import json

import pytest
from pyspark.sql import functions as F

from docvet.operators import policy as P
from docvet.operators import quality as Q

CONTEXTS = [
    {"a": {"b": {"c": 1}}, "a.b": "whole", "n": None}, {"a": {"b": {"c": "x"}}}, {"a": {"b": [1, 2]}}, {"a": [{"b": 1}]}, {"a": "b"}, {"a": {"b": None}}, {"a.b.c": None, "a": {"b": {"c": 5}}},
    {}, [1, 2], "text", 5, None, {"a": {"b": {}}}, {"a": {"b.c": 3}}, {"it's": {"x\\y": "odd"}}, {"a": {"b": {"c": [True, 1.0, 2.5, "T ", [7, "in"], None]}}}, {"a": {"b": True}, "x": -3}, {"a": {"b": {"c": 7}}},
]
NAMES = ("a", "a.b", "a.b.c", "n", "it's.x\\y", "x", "missing")


def plain(context, name):
    if not isinstance(context, dict):
        return None
    if name in context:
        return context[name]
    for part in name.split("."):
        if not isinstance(context, dict) or part not in context:
            return None
        context = context[part]
    return context


def typed(value):
    text = lambda x: "none" if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    if value is None:
        return None
    if isinstance(value, list):
        return "list", [text(x) for v in value for x in (v if isinstance(v, list) else [v]) if not isinstance(x, dict)]
    if isinstance(value, dict):
        return "object", sorted(value)
    return ("flag" if isinstance(value, bool) else "text" if isinstance(value, str) else "number"), [text(value)]


def test_signals_equal_a_plain_lookup(spark):
    rows = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(CONTEXTS)], "k int, j string")
    got = {r.k: r.s for r in rows.select("k", P.variant_signals(F.parse_json("j"), NAMES).alias("s")).collect()}
    for k, c in enumerate(CONTEXTS):
        found = {n: (v.kind, sorted(v["items"]) if v.kind == "object" else [x for x in v["items"] if not x.startswith("{")]) for n, v in got[k].items()}
        assert found == {n: t for n in NAMES if (t := typed(plain(c, n)))}, c


def test_null_context_and_dotted_conditions(spark):
    pack = P.PolicyPack((
        P.Policy("A", "a", "d", "block", all_of=(P.Condition("a.b.c", "gte", 3),)), P.Policy("B", "b", "d", "warn", any_of=(P.Condition("a.b", "contains", "c"), P.Condition("a.b", "equals", "whole"))),
        P.Policy("C", "c", "d", "warn", all_of=(P.Condition("x", "not_allowlisted", "a.b"),)),
    ))
    assert P.pack_signals(pack) == ("a.b", "a.b.c", "x")
    rows = spark.createDataFrame([(str(k), json.dumps(c)) for k, c in enumerate(CONTEXTS)] + [("none", None)], "context_id string, j string")
    contexts = rows.select("context_id", F.lit("warn_mode").alias("mode"), F.lit("low").alias("risk_level"), P.variant_signals(F.parse_json("j"), P.pack_signals(pack)).alias("signals"),
                           F.array().cast("array<string>").alias("evidence_span_ids"), F.lit(1.0).alias("confidence"))
    got = {}
    for r in P.policy_matches(P.evaluate_pack(contexts, pack)).collect():
        got.setdefault(r.policy_id, set()).add(r.context_id)
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    assert got["A"] == {str(k) for k, c in enumerate(CONTEXTS) if (number(plain(c, "a.b.c")) or 0) >= 3}
    assert got["B"] == {str(k) for k, c in enumerate(CONTEXTS) if (isinstance(plain(c, "a.b"), dict) and "c" in plain(c, "a.b")) or plain(c, "a.b") == "whole"}
    assert "16" in got["C"] and "none" in got["C"]


GOOD = {
    "graph_edge": dict(edge_id="e", edge_type="calls", source_node_id="a", source_node_type="tool", target_node_id="b", target_node_type="external_domain", weight=0.0, evidence_span_ids=["s"]),
    "scan_run": dict(run_id="r", source_id="s", status="failed", risk_score=None),
    "tool_call": dict(call_id="1", action_type="a", tool_name="t", risk_level="low", source_context_ids=[]),
    "sandbox_output": dict(task_id="t", tool_id="t", model_id="m", policy_mode="p", final_report="r", latency=0.0, agent_steps=[], attack_id=None, attempted_actions=["a"], blocked_actions=[]),
    "policy_explanation": dict(policy_id="p", decision="sandbox_only", confidence=1.0),
    "evidence_citation": dict(evidence_span_id="e", start_line=None, end_line=3),
}
TYPES = {"weight": "double", "latency": "double", "confidence": "double", "risk_score": "int", "start_line": "int", "end_line": "int", **{n: "array<string>" for n in ("evidence_span_ids", "source_context_ids", "agent_steps", "attempted_actions", "blocked_actions")}}
BAD = {
    "graph_edge": [("weight", -0.1, "weight_range"), ("weight", None, "weight_range"), ("evidence_span_ids", ["x", "\t"], "evidence_span_ids_free_of_blanks"), ("target_node_type", "tool", "ends_fit_type"), ("edge_type", "odd", "ends_fit_type"), ("edge_id", " ", "edge_id_not_blank")],
    "scan_run": [("risk_score", 101, "risk_score_range"), ("risk_score", -1, "risk_score_range"), ("status", None, "status_known"), ("source_id", None, "source_id_present")],
    "tool_call": [("tool_name", "", "tool_name_not_blank"), ("risk_level", "LOW", "risk_level_known"), ("source_context_ids", [""], "source_context_ids_free_of_blanks")],
    "sandbox_output": [("blocked_actions", ["z"], "blocked_were_attempted"), ("latency", -1.0, "latency_range"), ("attack_id", "", "attack_id_not_blank"), ("agent_steps", [" "], "agent_steps_free_of_blanks")],
    "policy_explanation": [("confidence", 1.1, "confidence_range"), ("decision", "deny", "decision_known")],
    "evidence_citation": [("start_line", 4, "line_order"), ("evidence_span_id", "\n", "evidence_span_id_not_blank")],
}


@pytest.mark.parametrize("kind", sorted(GOOD))
def test_each_check_names_its_fault(spark, kind):
    key = Q.RECORD_CHECKS[kind][0]
    schema = ", ".join(f"{n} {TYPES.get(n, 'string')}" for n in GOOD[kind])
    assert Q.record_violations(spark.createDataFrame([tuple(GOOD[kind].values())], schema), kind).count() == 0
    for column, value, check in BAD[kind]:
        row = GOOD[kind] | {column: value}
        got = Q.record_violations(spark.createDataFrame([tuple(row.values())], schema), kind).collect()
        assert [tuple(r) for r in got] == [(kind, row[key], check)]


def test_every_kind_reads_only_its_columns_and_empty_tables(spark):
    from docvet.plans.scan_queries import FAULTY_RECORDS

    assert set(FAULTY_RECORDS) == set(Q.RECORD_CHECKS)
    for kind, text in FAULTY_RECORDS.items():
        assert Q.record_violations(spark.sql(f"SELECT {text} FROM {{t}}", t=spark.range(0).withColumnRenamed("id", "n")), kind).collect() == []
