"""Registered queries: admission, lines, rule findings, risk, reports, stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import text as X
from docvet.functions.ids import canonical_json
from docvet.functions.rules import CREDENTIAL_PERMISSION_RULES, DEFAULT_RULES, PROMPT_INJECTION_RULES, enabled_rules
from docvet.operators import lines as L
from docvet.operators import quality as Q
from docvet.operators import report as P
from docvet.operators.detect import scan_rules
from docvet.operators.risk import assess_risk, contributions
from docvet.operators.schemas import artifact_type
from docvet.plans import inputs as I
from docvet.plans.oracle import ART, CHECKED, FINDINGS, LINES, RISK, preview_sql
from docvet.session import shared_folder, shared_table
from docvet.sources import files as S
from docvet.sources import stores as ST
from docvet.sources.bucketed import bucketed_table, buckets_for, text_bytes

_ARTIFACTS: dict[tuple, DataFrame] = {}
_FINDINGS: dict[tuple, DataFrame] = {}
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 16 << 20


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifact rows, derived and written once per application and folder, like the stored table they stand for; bucketed by artifact."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ARTIFACTS:
        rows = I.derived(spark, d, I.ARTIFACTS)
        _ARTIFACTS[key] = bucketed_table(rows, "artifact_id", buckets_for(text_bytes(rows, "raw_text"), BUCKET_BYTES))
    return _ARTIFACTS[key]


def artifact_texts(spark: SparkSession, d: str) -> DataFrame:
    """Artifact rows for one reader: the stored table where it is written, else as they are derived, which moves and writes no text.

    Documents in fewer parts than there are cores, up to ``I.LEAST_TASKS``, are dealt first.
    """
    if (spark.sparkContext.applicationId, d) in _ARTIFACTS:
        return artifacts(spark, d)
    rows, tasks = I.derived(spark, d, I.ARTIFACTS), min(I.LEAST_TASKS, spark.sparkContext.defaultParallelism)
    parts = I.table(spark, d, "documents").select(F.spark_partition_id().alias("part")).distinct().count()
    return rows if parts >= tasks else rows.repartition(tasks)


def artifact_keys(spark: SparkSession, d: str) -> DataFrame:
    """Artifact rows without the text, which then is not read."""
    return artifacts(spark, d).drop("raw_text")


def checked(spark: SparkSession, d: str) -> DataFrame:
    sized = artifacts(spark, d).withColumn("size_bytes", F.octet_length("raw_text"))
    return S.admission(sized, path="path")


def admitted(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).where(F.col("skip_reason").isNull())


def scan_inputs(spark: SparkSession, d: str) -> DataFrame:
    return admitted(spark, d).select("artifact_id", "run_id", "source_id", "path", "raw_text")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """What all rules find, written once per application and folder; the queries of single rule sets scan the texts themselves."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FINDINGS:
        _FINDINGS[key] = shared_table(scan_rules(scan_inputs(spark, d)))
    return _FINDINGS[key]


def runs(spark: SparkSession, d: str) -> DataFrame:
    """All runs, also those whose artifacts were all skipped."""
    return artifact_keys(spark, d).select("run_id", "source_id").distinct()


def assessment(spark: SparkSession, d: str) -> DataFrame:
    return assess_risk(runs(spark, d), findings(spark, d))


FINDING_COLUMNS = ("finding_id", "artifact_id", "rule_id", "category", "severity", "confidence", "span_id", "start_line", "end_line", "preview", "content_hash")


def _report(spark: SparkSession, d: str) -> DataFrame:
    return P.report_findings(findings(spark, d))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    sources = runs(spark, d).withColumn("source_path", F.concat(F.lit("/data/"), "run_id"))
    return P.report_headers(assessment(spark, d), sources)


def admission_query(spark, d):
    rows = checked(spark, d)
    return rows.select(
        "artifact_id", "path", "extension", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"),
        F.when(F.col("skip_reason").isNull(), F.sha2("raw_text", 256)).otherwise("").alias("content_hash"),
    )


def decode_query(spark, d):
    pages = I.table(spark, d, "pages")
    broken = F.when(F.col("page_id") % 5 == 0, F.concat(F.encode("html", "UTF-8"), F.lit(b"\xff"))).otherwise(F.encode("html", "UTF-8"))
    text = S.decode_text(broken)
    return pages.select("page_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_hash"))


def lines_query(spark, d):
    return L.explode_lines(artifacts(spark, d).select("artifact_id", "raw_text"))


def span_requests(spark, d):
    base = artifacts(spark, d).select("artifact_id", "doc_id")
    ranges = F.array(
        F.struct(F.lit(1).alias("start_line"), F.lit(2).alias("end_line")),
        F.struct((F.abs("doc_id") % 7 + 1).cast("int").alias("start_line"), (F.abs("doc_id") % 5 + 4).cast("int").alias("end_line")),
        F.struct((F.abs("doc_id") % 40 + 1).cast("int").alias("start_line"), (F.abs("doc_id") % 40 + 60).cast("int").alias("end_line")),
    )
    return base.select("artifact_id", F.inline(ranges)).withColumn("span_type", F.lit("review"))


def spans_query(spark, d):
    spans = L.resolve_span_requests(artifacts(spark, d), span_requests(spark, d))
    return spans.select("artifact_id", "start_line", "end_line", *[
        F.coalesce(c, F.lit("")).alias(c) for c in ("span_id", "preview", "content_hash", "error")
    ])


def preview_query(spark, d):
    docs = I.table(spark, d, "documents")
    return docs.select("doc_id", X.preview(F.col("text"), 160).alias("preview"), X.preview(F.col("text"), 40).alias("short_preview"))


def ids_query(spark, d):
    files = admitted(spark, d).select(
        F.concat(F.lit("/data/"), "run_id").alias("root_path"), F.col("path").alias("relative_path"), F.sha2("raw_text", 256).alias("content_hash")
    )
    return P.run_ids(files)


def artifact_ids_query(spark, d):
    return admitted(spark, d).select(
        "doc_id", P.artifact_id(F.col("path"), F.sha2("raw_text", 256)).alias("artifact_key"), P.source_id(F.concat(F.lit("/data/"), "run_id")).alias("source_key")
    )


def latest_query(spark, d):
    events = I.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    latest = ST.latest_per_key(events, ["user_id", "event_type"], "ts")
    return latest.select("user_id", "event_type", "event_id", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def index_query(spark, d):
    found = findings(spark, d)
    twice = F.explode(F.array(F.lit(0), F.lit(100_000)))
    entries = found.select("run_id", "finding_id", (F.col("start_line") * 100 + F.col("rule_rank")).alias("p"), twice.alias("again"))
    index = ST.run_finding_index(entries.select("run_id", "finding_id", (F.col("p") + F.col("again")).alias("pos")))
    records = found.where(F.col("severity") != "low").select("finding_id", "severity")
    return ST.findings_for_runs(index, records).select("run_id", "finding_id", "pos", "severity")


def markdown_query(spark, d):
    report = _report(spark, d)
    rendered = P.markdown_lines(_headers(spark, d), report, P.unique_recommendations(report))
    return rendered.select("run_id", "section", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("path", "start_line", "rule_rank")
    ], "line_pos", "line")


def store_query(spark, d):
    """Admitted files written to the artifact store, raw text and parsed records apart, and read back under their ids."""
    rows = admitted(spark, d).select("source_id", "artifact_id", "path", F.sha2("raw_text", 256).alias("content_hash"), "raw_text", "extension")
    folder = shared_folder(spark)
    ST.write_artifact_store(rows, rows.select("source_id", "artifact_id", "extension"), folder)
    raw = spark.read.schema("artifact_id string, path string, content_hash string, raw_text string, source_id string").parquet(f"{folder}/artifacts_raw")
    parsed = spark.read.schema("artifact_id string, extension string, source_id string").parquet(f"{folder}/artifacts_parsed")
    texts = raw.select("source_id", "artifact_id", "path", "content_hash", (F.sha2("raw_text", 256) == F.col("content_hash")).alias("whole"))
    return texts.join(parsed, ["source_id", "artifact_id"])


def report_file_query(spark, d):
    """Report records written as JSON lines and read back: every finding under its run."""
    folder = shared_folder(spark)
    ST.write_report_json(_headers(spark, d), _report(spark, d), folder)
    heads = spark.read.schema("report_id string, run_id string, risk_score int, finding_count bigint").json(f"{folder}/reports")
    found = spark.read.schema("run_id string, finding_id string, severity string, file_path string, start_line int, evidence_id string").json(f"{folder}/findings")
    return heads.join(found, "run_id")


def jsonl_query(spark, d):
    found = findings(spark, d).select("finding_id", "rule_id", "severity", "confidence", "start_line")
    return found.select("finding_id", canonical_json(*found.columns).alias("json_line"))


def digest_query(spark, d):
    return Q.table_digest(I.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source", F.sha2("text", 256).alias("text_hash")))


def findings_of(rules):
    return lambda spark, d: scan_rules(scan_inputs(spark, d), rules).select(*FINDING_COLUMNS)


def core_query(spark, d):
    core = P.core_findings(findings(spark, d), assessment(spark, d))
    return core.withColumn("evidence_span_ids", F.array_join("evidence_span_ids", ","))


def snapshot_query(spark, d):
    spans = findings(spark, d).select(*Q.SPAN_FIELDS).dropDuplicates(["span_id"])
    return Q.span_snapshot_hashes(spans)


def manifest_query(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source", F.sha2("text", 256).alias("text_hash"))
    manifest = Q.scan_manifest(findings(spark, d), Q.table_digest(docs), "rule-scan", "documents", 20260617, ST.BUNDLE_NAMES)
    return manifest.withColumn("artifact_filenames", F.array_join("artifact_filenames", ","))


def faceted_query(spark, d):
    report = _report(spark, d)
    evidence = report.select(
        "evidence_id", "finding_type", artifact_type(S.suffix(F.col("file_path"))).alias("artifact_type"), "file_path", "preview",
        F.col("inferred_risk").alias("context_text"), F.when(F.col("rule_rank") < 6, "untrusted").otherwise("unknown").alias("source_trust"),
    )
    hits = Q.search_evidence(evidence, "notes", source_trust="untrusted", artifact_type="markdown")
    return hits.select("evidence_id", "finding_type", "file_path").distinct()


def facets_query(spark, d):
    return Q.facet_values(findings(spark, d).select("category", "severity", "detector"), "category", "severity", "detector")


def inventory_query(spark, d):
    return Q.inventory_totals(assessment(spark, d))


def violations_query(spark, d):
    found = findings(spark, d)
    spoiled = found.select(
        F.when(F.col("start_line") % 5 == 0, F.lit(" ")).otherwise(F.col("finding_id")).alias("finding_id"),
        F.when(F.col("rule_rank") == 3, F.lit("severe")).otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("rule_rank") == 1, F.col("confidence") + 1).otherwise(F.col("confidence")).alias("confidence"),
        "start_line", (F.col("end_line") - F.when(F.col("rule_rank") == 6, 1).otherwise(0)).alias("end_line"),
    )
    return Q.finding_violations(spoiled).groupBy("failed_check").agg(F.count("*").alias("n"))


#: Records of every kind made from a document's number n, with a fault where n has a certain divisor; Spark and DuckDB read the same text.
FAULTY_RECORDS = {
    "source": "'s' || n AS source_id, CASE WHEN n % 19 > 0 THEN 'u' END AS source_url, CASE WHEN n % 13 = 0 THEN 'ftp' ELSE 'url' END AS source_type, CASE WHEN n % 17 = 0 THEN 'lost' ELSE 'crawled' END AS crawl_status",
    "artifact": "'a' || n AS artifact_id, 's' AS source_id, CASE WHEN n % 19 <> 1 THEN 'p' END AS path, 'h' AS content_hash, CASE WHEN n % 13 = 1 THEN 'zip' ELSE 'json' END AS artifact_type",
    "capability": "'c' || n AS capability_id, 'c' AS name, n % 23 - 1 AS risk_weight",
    "tool": "'t' || n AS tool_id, 's' AS source_id, CASE WHEN n % 11 > 0 THEN 't' END AS name",
    "evidence_span": "'e' || n AS span_id, 'a' AS artifact_id, 'p' AS preview, 't' AS span_type, 'h' AS content_hash, n % 29 AS start_line, n % 29 + n % 31 AS end_line",
    "finding": "'f' || n AS finding_id, 's' AS source_id, 't' AS finding_type, CASE WHEN n % 7 = 0 THEN 'odd' ELSE 'low' END AS severity, (n % 37) / 36.0 + CASE WHEN n % 41 = 0 THEN 2 ELSE 0 END AS confidence, 'r' AS rationale, CASE WHEN n % 43 > 0 THEN 'r' END AS recommendation, CASE n % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'maybe' END AS policy_decision",
    "scan_run": "'r' || n AS run_id, 's' AS source_id, CASE WHEN n % 37 = 0 THEN 'odd' ELSE 'running' END AS status, CASE n % 31 WHEN 0 THEN 101 WHEN 1 THEN NULL ELSE n % 100 END AS risk_score",
    "experiment_log": "CASE WHEN n % 5 > 0 THEN 'x' || n END AS experiment_id",
    "graph_node": "'n' || n AS node_id, CASE WHEN n % 41 = 0 THEN ' ' ELSE 'l' END AS label, CASE WHEN n % 43 = 0 THEN 'robot' ELSE 'tool' END AS node_type",
    "graph_edge": "'g' || n AS edge_id, 'a' AS source_node_id, CASE WHEN n % 61 = 0 THEN '' ELSE 'b' END AS target_node_id, CASE WHEN n % 47 = 0 THEN -0.5 ELSE 1.0 END AS weight, CASE WHEN n % 53 = 0 THEN array('x', ' ') END AS evidence_span_ids, 'mentions' AS edge_type, 'tool' AS source_node_type, CASE WHEN n % 59 = 0 THEN 'parameter' ELSE 'env_var' END AS target_node_type",
    "tool_call": "'k' || n AS call_id, 'read' AS action_type, CASE WHEN n % 61 = 0 THEN ' ' ELSE 't' END AS tool_name, CASE WHEN n % 71 = 0 THEN 'odd' ELSE 'low' END AS risk_level, CASE WHEN n % 67 = 0 THEN array('') ELSE array('c') END AS source_context_ids",
    "sandbox_output": "'b' || n AS task_id, 't' AS tool_id, 'm' AS model_id, 'p' AS policy_mode, 'r' AS final_report, CASE WHEN n % 79 = 0 THEN -1.0 ELSE 0.5 END AS latency, CASE WHEN n % 89 = 0 THEN array('s', '') ELSE array('s') END AS agent_steps, CASE n % 83 WHEN 0 THEN ' ' WHEN 1 THEN 'x' END AS attack_id, array('x', 'y') AS attempted_actions, CASE WHEN n % 73 = 0 THEN array('y', 'z') ELSE array('y') END AS blocked_actions",
    "evidence_citation": "'v' || n AS evidence_span_id, CASE WHEN n % 2 = 0 THEN 5 END AS start_line, CASE WHEN n % 101 = 0 THEN 4 ELSE 6 END AS end_line",
    "policy_explanation": "'y' || n AS policy_id, CASE WHEN n % 10 = 0 THEN 'odd' ELSE 'warn' END AS decision, CASE WHEN n % 97 = 0 THEN 1.5 ELSE 0.25 END AS confidence",
}
#: (kind, letter of its key, failed check, when): what the checks must find.
FAULTS = (
    ("source", "s", "source_url_present", "n % 19 = 0"), ("source", "s", "source_type_known", "n % 13 = 0"), ("source", "s", "crawl_status_known", "n % 17 = 0"),
    ("artifact", "a", "path_present", "n % 19 = 1"), ("artifact", "a", "artifact_type_known", "n % 13 = 1"), ("capability", "c", "risk_weight_range", "n % 23 = 0"), ("tool", "t", "name_present", "n % 11 = 0"),
    ("evidence_span", "e", "start_line_range", "n % 29 = 0"), ("evidence_span", "e", "end_line_range", "n % 29 = 0 AND n % 31 = 0"),
    ("finding", "f", "severity_known", "n % 7 = 0"), ("finding", "f", "confidence_range", "n % 41 = 0"), ("finding", "f", "recommendation_present", "n % 43 = 0"), ("finding", "f", "policy_decision_known", "n % 3 = 1"),
    ("scan_run", "r", "status_known", "n % 37 = 0"), ("scan_run", "r", "risk_score_range", "n % 31 = 0"), ("graph_node", "n", "label_not_blank", "n % 41 = 0"), ("graph_node", "n", "node_type_known", "n % 43 = 0"),
    ("graph_edge", "g", "target_node_id_not_blank", "n % 61 = 0"), ("graph_edge", "g", "weight_range", "n % 47 = 0"), ("graph_edge", "g", "evidence_span_ids_free_of_blanks", "n % 53 = 0"), ("graph_edge", "g", "ends_fit_type", "n % 59 = 0"),
    ("tool_call", "k", "tool_name_not_blank", "n % 61 = 0"), ("tool_call", "k", "risk_level_known", "n % 71 = 0"), ("tool_call", "k", "source_context_ids_free_of_blanks", "n % 67 = 0"),
    ("sandbox_output", "b", "latency_range", "n % 79 = 0"), ("sandbox_output", "b", "agent_steps_free_of_blanks", "n % 89 = 0"), ("sandbox_output", "b", "attack_id_not_blank", "n % 83 = 0"), ("sandbox_output", "b", "blocked_were_attempted", "n % 73 = 0"),
    ("evidence_citation", "v", "line_order", "n % 202 = 0"), ("policy_explanation", "y", "decision_known", "n % 10 = 0"), ("policy_explanation", "y", "confidence_range", "n % 97 = 0"),
)


def all_kinds_query(spark, d):
    numbers = I.table(spark, d, "documents").select(F.col("doc_id").alias("n"))
    return reduce(DataFrame.union, [Q.record_violations(spark.sql(f"SELECT {text} FROM {{numbers}}", numbers=numbers), kind) for kind, text in FAULTY_RECORDS.items()])


_F = f"WITH {ART}, {CHECKED}, {LINES}, {FINDINGS}"
_R = f"{_F}, {RISK}"
_COLS = ", ".join(FINDING_COLUMNS)
_DIGEST_ROWS = """SELECT sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source
 || '","text_hash":"' || sha256(text) || '"}') AS h FROM documents"""
_DIGEST = f"""SELECT count(*) AS row_count, sha256(concat_ws(':', count(*)::VARCHAR, {', '.join(
    f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR" for i in range(4))})) AS digest FROM ({_DIGEST_ROWS})"""
_REPORT_ORDER = "path, artifact_id, detector_rank, start_line, rule_rank"

_DIGEST_SQL = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR" for i in range(4))

QUERIES = {
    "a1_file_admission": (admission_query, f"""WITH {ART}, {CHECKED}
SELECT artifact_id, path, extension, coalesce(skip_reason, '') AS skip_reason,
 CASE WHEN skip_reason IS NULL THEN sha256(raw_text) ELSE '' END AS content_hash FROM checked"""),
    "a2_lossy_decode": (decode_query, """SELECT page_id, length(t) AS n_chars, sha256(t) AS text_hash
FROM (SELECT page_id, html || CASE WHEN page_id % 5 = 0 THEN chr(65533) ELSE '' END AS t FROM pages)"""),
    "a6_artifact_store": (store_query, f"""WITH {ART}, {CHECKED} SELECT source_id, artifact_id, path, sha256(raw_text) AS content_hash, true AS whole, extension FROM checked WHERE skip_reason IS NULL"""),
    "a7_latest_per_key": (latest_query, """SELECT user_id, event_type, event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1"""),
    "a8_run_finding_index": (index_query, f"""{_F} SELECT run_id, finding_id, min(start_line * 100 + rule_rank) AS pos, min(severity) AS severity
FROM findings WHERE severity <> 'low' GROUP BY run_id, finding_id"""),
    "a9_report_json": (report_file_query, f"""{_R} SELECT 'report_' || run_id AS report_id, run_id, risk_score, finding_count, finding_id, f.severity, path AS file_path, start_line, span_id AS evidence_id
FROM findings f JOIN risk USING (run_id)"""),
    "a10_markdown_report_lines": (markdown_query, f"""{_R},
heads AS (SELECT run_id, 0 AS section, '' AS path, '' AS start_line, '' AS rule_rank, unnest(['# Scan Report: ' || run_id, '', '## Summary', '',
 '- Source: `/data/' || run_id || '`', '- Risk score: ' || risk_score, '- Risk level: ' || risk_level, '- Policy decision: ' || policy_decision,
 '- Finding count: ' || finding_count, '', '## Findings', '']) AS line, generate_subscripts(range(12), 1) - 1 AS line_pos FROM risk),
nothing AS (SELECT run_id, 1, '', '', '', unnest(['No findings detected.', '']), generate_subscripts(range(2), 1) - 1 FROM risk WHERE finding_count = 0),
body AS (SELECT run_id, 1, path, start_line::VARCHAR, rule_rank::VARCHAR, unnest(['### ' || category, '', '- Finding ID: `' || finding_id || '`', '- Severity: ' || severity,
 '- Confidence: ' || printf('%.2f', confidence), '- Inferred risk: ' || rationale, '- Recommendation: ' || recommendation, '- Evidence:',
 '  - `' || span_id || '` at `' || path || ':' || start_line || '-' || end_line || '`: ' || preview, '']), generate_subscripts(range(10), 1) - 1 FROM findings),
rechead AS (SELECT run_id, 2, '', '', '', unnest(['## Recommendations', '']), generate_subscripts(range(2), 1) - 1 FROM risk),
norec AS (SELECT run_id, 3, '', '', '', '- No action required.', 0 FROM risk WHERE finding_count = 0),
recs AS (SELECT run_id, recommendation, row_number() OVER (PARTITION BY run_id ORDER BY {_REPORT_ORDER}) AS pos FROM (
 SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY run_id, recommendation ORDER BY {_REPORT_ORDER}) = 1)),
recl AS (SELECT run_id, 3, '', '', pos::VARCHAR, '- ' || recommendation, 0 FROM recs),
tail AS (SELECT run_id, 4, '', '', '', '', 0 FROM risk)
SELECT run_id, section, path, start_line, rule_rank, line_pos, line FROM heads UNION ALL
SELECT a, b, c, d, e, g, f FROM (SELECT * FROM nothing UNION ALL SELECT * FROM body UNION ALL SELECT * FROM rechead UNION ALL SELECT * FROM norec UNION ALL SELECT * FROM recl UNION ALL SELECT * FROM tail) AS t(a, b, c, d, e, f, g)"""),
    "a11_results_jsonl": (jsonl_query, f"""{_F} SELECT finding_id, '{{"confidence":' || confidence || ',"finding_id":"' || finding_id || '","rule_id":"' || rule_id || '","severity":"' || severity || '","start_line":' || start_line || '}}' AS json_line FROM findings"""),
    "a12_scan_manifest": (manifest_query, f"""{_F}, dig AS ({_DIGEST})
SELECT 'rule-scan' AS experiment_name, 'documents' AS dataset_path, (SELECT digest FROM dig) AS dataset_hash, count(*) AS result_count, 20260617 AS random_seed,
 '{",".join(ST.BUNDLE_NAMES)}' AS artifact_filenames FROM findings"""),
    "a14_table_digest": (digest_query, _DIGEST),
    "b1_lines": (lines_query, f"WITH {ART}, {CHECKED}, {LINES} SELECT artifact_id, line_no, line FROM lines"),
    "b2_injection_findings": (findings_of(PROMPT_INJECTION_RULES), f"{_F} SELECT {_COLS} FROM findings WHERE detector = 'prompt_injection'"),
    "b3_credential_permission_findings": (findings_of(CREDENTIAL_PERMISSION_RULES), f"{_F} SELECT {_COLS} FROM findings WHERE detector <> 'prompt_injection'"),
    "b4_detector_filter": (findings_of(enabled_rules(DEFAULT_RULES, ("prompt_injection", "permission_signal"), 0.75)),
                           f"{_F} SELECT {_COLS} FROM findings WHERE detector <> 'credential_reference' AND confidence >= 0.75"),
    "b5_evidence_spans": (spans_query, f"""WITH {ART}, {CHECKED}, {LINES},
req AS (SELECT artifact_id, doc_id, 1 AS s, 2 AS e FROM artifacts UNION ALL SELECT artifact_id, doc_id, abs(doc_id) % 7 + 1, abs(doc_id) % 5 + 4 FROM artifacts
 UNION ALL SELECT artifact_id, doc_id, abs(doc_id) % 40 + 1, abs(doc_id) % 40 + 60 FROM artifacts),
cut AS (SELECT r.artifact_id, s, e, string_agg(line, chr(10) ORDER BY line_no) AS t, count(line) AS n FROM req r LEFT JOIN lines l
 ON l.artifact_id = r.artifact_id AND line_no BETWEEN s AND e GROUP BY ALL),
p AS (SELECT *, {preview_sql('t', 160)} AS pv, CASE WHEN e < s THEN 'Evidence span end_line must be greater than or equal to start_line.'
 WHEN n = 0 THEN 'Evidence span start_line is outside the artifact text.' ELSE '' END AS error FROM cut)
SELECT artifact_id, s AS start_line, e AS end_line, error,
 CASE WHEN error = '' THEN 'span_' || substr(sha256(artifact_id || ':review:' || s || ':' || e || ':' || sha256(t)), 1, 16) ELSE '' END AS span_id,
 CASE WHEN error = '' THEN pv ELSE '' END AS preview, CASE WHEN error = '' THEN sha256(t) ELSE '' END AS content_hash FROM p"""),
    "b6_preview": (preview_query, f"SELECT doc_id, {preview_sql('text', 160)} AS preview, {preview_sql('text', 40)} AS short_preview FROM documents"),
    "b7_run_ids": (ids_query, f"""WITH {ART}, {CHECKED} SELECT '/data/' || run_id AS root_path,
 'run_' || substr(sha256('/data/' || run_id || ':' || sha256(concat_ws(':', count(*)::VARCHAR, {_DIGEST_SQL}))), 1, 16) AS run_id,
 'source_' || substr(sha256('/data/' || run_id), 1, 16) AS source_id
FROM (SELECT *, sha256(path || ':' || sha256(raw_text)) AS h FROM checked WHERE skip_reason IS NULL) AS rows GROUP BY rows.run_id"""),
    "b7_artifact_ids": (artifact_ids_query, f"""WITH {ART}, {CHECKED} SELECT doc_id, 'artifact_' || substr(sha256(path || ':' || sha256(raw_text)), 1, 16) AS artifact_key,
 'source_' || substr(sha256('/data/' || run_id), 1, 16) AS source_key FROM checked WHERE skip_reason IS NULL"""),
    "b30_record_violations": (violations_query, f"""{_F}, bad AS (SELECT CASE WHEN start_line % 5 = 0 THEN ' ' ELSE finding_id END AS finding_id,
 CASE WHEN rule_rank = 3 THEN 'severe' ELSE severity END AS severity, confidence + CASE WHEN rule_rank = 1 THEN 1 ELSE 0 END AS confidence, start_line,
 end_line - CASE WHEN rule_rank = 6 THEN 1 ELSE 0 END AS end_line FROM findings),
f AS (SELECT 'finding_id_not_blank' AS failed_check FROM bad WHERE trim(finding_id) = '' UNION ALL SELECT 'severity_known' FROM bad WHERE severity NOT IN ('low','medium','high','critical')
 UNION ALL SELECT 'confidence_range' FROM bad WHERE confidence > 1 OR confidence < 0 UNION ALL SELECT 'line_order' FROM bad WHERE end_line < start_line)
SELECT failed_check, count(*) AS n FROM f GROUP BY 1"""),
    "b30_all_record_kinds": (all_kinds_query, "WITH d AS (SELECT doc_id AS n FROM documents) SELECT 'experiment_log' AS kind, NULL AS record_key, 'experiment_id_present' AS failed_check FROM d WHERE n % 5 = 0"
        + "".join(f" UNION ALL SELECT '{kind}', '{letter}' || n, '{check}' FROM d WHERE {when}" for kind, letter, check, when in FAULTS)),
    "b32_finding_points": (lambda s, d: contributions(findings(s, d), "run_id"), f"""{_F} SELECT run_id, finding_id, severity, confidence, points FROM findings"""),
    "b46_core_findings": (core_query, f"""{_R} SELECT f.finding_id, f.source_id, f.category AS finding_type, f.severity, f.confidence, f.span_id AS evidence_span_ids,
 f.rationale, f.recommendation, r.policy_decision FROM findings f JOIN risk r USING (run_id)"""),
    "b50_faceted_search": (faceted_query, f"""{_F} SELECT DISTINCT span_id AS evidence_id, category AS finding_type, path AS file_path FROM findings
WHERE rule_rank < 6 AND (path ILIKE '%.md' OR path ILIKE '%.markdown') AND lower(concat_ws(' ', span_id, category, 'markdown', path, preview, rationale)) LIKE '%notes%'"""),
    "c2_report_findings": (lambda s, d: _report(s, d).drop("path", "detector_rank", "rule_rank"), f"""{_F} SELECT run_id, finding_id, category AS finding_type, severity, confidence, rule_id,
 span_id AS evidence_id, artifact_id, path AS file_path, start_line, end_line, preview, content_hash, rationale AS inferred_risk, recommendation FROM findings"""),
    "d1_risk_assessment": (assessment, f"{_R} SELECT * FROM risk"),
    "d2_report_headers": (_headers, f"""{_R} SELECT 'report_' || run_id AS report_id, run_id, source_id, '/data/' || run_id AS source_path, risk_score, risk_level, policy_decision, finding_count,
 'Detected ' || finding_count || ' evidence-backed finding(s). Risk is ' || risk_level || ' with policy decision ' || policy_decision || '.' AS summary
FROM risk JOIN (SELECT DISTINCT run_id, source_id FROM artifacts) USING (run_id)"""),
    "d3_recommendations": (lambda s, d: P.unique_recommendations(_report(s, d)), f"""{_F}, firsts AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY run_id, recommendation ORDER BY {_REPORT_ORDER}) = 1)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {_REPORT_ORDER}) AS pos, recommendation FROM firsts"""),
    "d23_span_snapshot_hashes": (snapshot_query, f"""{_F} SELECT DISTINCT span_id, sha256('{{"artifact_id":"' || artifact_id || '","content_hash":"' || content_hash || '","end_line":' || end_line
 || ',"preview":' || to_json(preview) || ',"span_id":"' || span_id || '","span_type":"' || category || '","start_line":' || start_line || '}}') AS snapshot_hash FROM findings"""),
    "d26_facet_values": (facets_query, f"""{_F}, u AS (SELECT 'category' AS facet, category AS value FROM findings UNION ALL SELECT 'severity', severity FROM findings UNION ALL SELECT 'detector', detector FROM findings)
SELECT facet, value, count(*) AS n FROM u GROUP BY 1, 2"""),
    "d26_inventory_totals": (inventory_query, f"""{_R} SELECT count(*) AS tool_count, sum(finding_count) AS finding_total, floor(avg(risk_score) + 0.5) AS mean_risk FROM risk"""),
}
