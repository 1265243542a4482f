"""Common table expressions of the oracle SQL. They rebuild the working tables and the scan with
DuckDB's own functions: unnested lines, a join with a rule table, windows."""

from __future__ import annotations

from docvet.functions.rules import DEFAULT_RULES, Rule
from docvet.plans.inputs import ARTIFACTS

ALLOWED_SQL = "('.md', '.markdown', '.json', '.yaml', '.yml', '.txt', '.toml')"

ART = f"artifacts AS ({ARTIFACTS})"

CHECKED = f"""checked AS (SELECT *, CASE WHEN list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build', '.git']) THEN 'ignored_path'
 WHEN extension NOT IN {ALLOWED_SQL} THEN 'unsupported_extension' WHEN strlen(raw_text) > 1000000 THEN 'file_too_large' END AS skip_reason
 FROM (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension FROM artifacts))"""

BREAKS = r"'\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"

LINES = f"""lines AS (SELECT doc_id, artifact_id, run_id, source_id, path, skip_reason, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
 FROM (SELECT *, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS l FROM (SELECT *, string_split_regex(raw_text, {BREAKS}) AS l0 FROM checked)))"""


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rules_sql(rules: tuple[Rule, ...] = DEFAULT_RULES) -> str:
    rows = ", ".join(
        f"({i}, {quoted(r.rule_id)}, {quoted(r.detector)}, {quoted(r.category)}, {quoted(r.pattern)}, {quoted(r.severity)}, {r.confidence}, {quoted(r.rationale)}, {quoted(r.recommendation)})"
        for i, r in enumerate(rules)
    )
    return (
        "rules AS (SELECT rule_rank, rule_id, detector, category, pattern, severity, confidence::DOUBLE AS confidence, rationale, recommendation FROM (VALUES "
        f"{rows}) AS r(rule_rank, rule_id, detector, category, pattern, severity, confidence, rationale, recommendation))"
    )


def preview_sql(text: str, chars: int) -> str:
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    clipped = f"rtrim(substr({flat}, 1, {chars}))"
    return f"""CASE WHEN length({flat}) <= {chars} THEN {flat} WHEN regexp_matches({clipped}, '^.+ [^ ]*$') THEN regexp_extract({clipped}, '^(.+) [^ ]*$', 1) ELSE {clipped} END"""


_TESTS = ", ".join(f"CASE WHEN regexp_matches(line, {quoted(r.pattern)}, 'i') THEN {i} END" for i, r in enumerate(DEFAULT_RULES))

FINDINGS = f"""{rules_sql()},
tested AS (SELECT *, unnest([{_TESTS}]) AS matched_rule FROM lines WHERE skip_reason IS NULL),
hits AS (SELECT l.*, r.*, sha256(line) AS content_hash, {preview_sql('line', 160)} AS preview FROM tested l JOIN rules r ON r.rule_rank = l.matched_rule),
spans AS (SELECT *, 'span_' || substr(sha256(artifact_id || ':' || category || ':' || line_no || ':' || line_no || ':' || content_hash), 1, 16) AS span_id FROM hits),
findings AS (SELECT *, line_no AS start_line, line_no AS end_line, CASE WHEN detector = 'prompt_injection' THEN 0 ELSE 1 END AS detector_rank,
 'finding_' || substr(sha256(artifact_id || ':' || rule_id || ':' || span_id), 1, 16) AS finding_id,
 CAST(round_even(CASE severity WHEN 'low' THEN 10 WHEN 'medium' THEN 35 WHEN 'high' THEN 65 ELSE 90 END * confidence, 0) AS INT) AS points FROM spans)"""

LEVEL = "CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END"
DECISION = "CASE risk_level WHEN 'critical' THEN 'block' WHEN 'high' THEN 'quarantine' WHEN 'medium' THEN 'warn' ELSE 'allow' END"

RISK = f"""risk AS (SELECT *, {DECISION} AS policy_decision FROM (SELECT *, {LEVEL} AS risk_level FROM (
 SELECT r.run_id, least(coalesce(sum(points), 0), 100) AS risk_score, count(finding_id) AS finding_count,
 count(*) FILTER (severity = 'low') AS low_count, count(*) FILTER (severity = 'medium') AS medium_count,
 count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'critical') AS critical_count
 FROM (SELECT DISTINCT run_id FROM artifacts) r LEFT JOIN findings f ON f.run_id = r.run_id GROUP BY r.run_id)))"""
