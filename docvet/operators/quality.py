"""Record validation, error records, request log rows, facets and inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions.ids import canonical_hash, multiset_digest
from docvet.functions.text import is_blank
from docvet.operators.graph import EDGE_SPECS, NODE_TYPES
from docvet.operators.policy import ACTION_PRIORITY

# Enums, error categories with their defaults, log states, latency buckets.
ENUMS = {
    "source_type": ("github_repo", "url", "package", "local_upload", "mcp_manifest"),
    "crawl_status": ("pending", "crawled", "failed"),
    "artifact_type": ("readme", "markdown", "json", "yaml", "package_manifest", "other"),
    "severity": ("low", "medium", "high", "critical"),
    "policy_decision": ("allow", "warn", "quarantine", "block"),
    "scan_status": ("pending", "running", "completed", "failed"),
    "log_status": ("started", "ok", "error", "blocked", "skipped"),
    "source_trust": ("trusted", "semi_trusted", "unknown", "untrusted", "hostile"),
    "risk_level": ("low", "medium", "high", "critical"),
    "policy_action": tuple(ACTION_PRIORITY),
}
ERROR_DEFAULTS = {
    "crawl_error": (502, True, True, "The source could not be crawled safely. Please retry later or use a local artifact."),
    "parse_error": (422, True, False, "The input could not be parsed. Please check the artifact format and try again."),
    "embedding_error": (503, True, True, "Evidence retrieval is temporarily unavailable. Please retry later."),
    "policy_error": (500, False, False, "The policy decision could not be completed safely."),
    "sandbox_error": (500, True, True, "The sandbox run could not be completed. Please retry with the same mock inputs."),
    "report_error": (500, False, False, "The report could not be generated safely."),
    "rate_limit_error": (429, True, True, "The request was rate limited. Please retry after a short delay."),
}
LATENCY_BUCKETS = ((250, "0-250"), (500, "250-500"), (1000, "500-1000"))
PUBLIC_ERROR_FIELDS = ("category", "error_code", "recoverable", "retryable", "message", "request_id", "trace_id", "run_id", "source_id")
PRIVATE_FIELDS = (
    "internal_message", "internal_stack_trace", "raw_text", "text", "query", "vector", "content", "context", "config_hash",
)


# Checks: each is true where the record is good.


def not_blank(name: str) -> Column:
    return F.col(name).isNotNull() & ~is_blank(F.col(name))


def blank_free_list(name: str) -> Column:
    return F.forall(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v: ~is_blank(v))


def in_range(name: str, low: float | None = None, high: float | None = None, nullable: bool = False) -> Column:
    good = F.lit(True)
    if low is not None:
        good = good & (F.col(name) >= low)
    if high is not None:
        good = good & (F.col(name) <= high)
    return (F.col(name).isNull() | good) if nullable else good


def one_of(name: str, enum: str) -> Column:
    return F.col(name).isin(*ENUMS[enum])


def ordered(low: str, high: str) -> Column:
    return F.col(low).isNull() | F.col(high).isNull() | (F.col(high) >= F.col(low))


def subset(inner: str, outer: str) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def violations(records: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per failed check; a check that is null counts as failed. Records are not dropped."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    return records.select(F.col(key).cast("string").alias("record_key"), F.explode(failed).alias("failed_check"))


def _present(*names: str) -> dict:
    return {f"{n}_present": (lambda n=n: F.col(n).isNotNull()) for n in names}


def _filled(*names: str) -> dict:
    return {f"{n}_not_blank": (lambda n=n: not_blank(n)) for n in names}


def _known(**enums: str) -> dict:
    return {f"{n}_known": (lambda n=n, e=e: one_of(n, e)) for n, e in enums.items()}


def _between(name: str, low: float | None = None, high: float | None = None, nullable: bool = False) -> dict:
    return {f"{name}_range": lambda: in_range(name, low, high, nullable)}


def _no_blank_in(*names: str) -> dict:
    return {f"{n}_free_of_blanks": (lambda n=n: blank_free_list(n)) for n in names}


def edge_spec() -> Column:
    """Whether the edge's ends are of the types that its own type joins."""
    actual = F.concat_ws(">", "edge_type", "source_node_type", "target_node_type")
    return actual.isin(*[f"{kind}>{source}>{target}" for kind, (source, target) in EDGE_SPECS.items()])


FINDING_CHECKS = {
    "finding_id_not_blank": lambda: not_blank("finding_id"),
    "severity_known": lambda: one_of("severity", "severity"),
    "confidence_range": lambda: in_range("confidence", 0.0, 1.0),
    "line_order": lambda: ordered("start_line", "end_line"),
    "start_line_positive": lambda: in_range("start_line", 1),
}
#: kind of record: (key column, checks by name); a check reads the columns that its record kind must have.
RECORD_CHECKS: dict[str, tuple[str, dict]] = {
    "source": ("source_id", {**_present("source_id", "source_url"), **_known(source_type="source_type", crawl_status="crawl_status")}),
    "artifact": ("artifact_id", {**_present("artifact_id", "source_id", "path", "content_hash"), **_known(artifact_type="artifact_type")}),
    "capability": ("capability_id", {**_present("capability_id", "name"), **_between("risk_weight", 0)}),
    "tool": ("tool_id", _present("tool_id", "source_id", "name")),
    "evidence_span": ("span_id", {**_present("span_id", "artifact_id", "preview", "span_type", "content_hash"), **_between("start_line", 1), **_between("end_line", 1)}),
    "finding": ("finding_id", {n: c for n, c in FINDING_CHECKS.items() if n in ("severity_known", "confidence_range")} | _present("finding_id", "source_id", "finding_type", "rationale", "recommendation")
                | {"policy_decision_known": lambda: F.col("policy_decision").isNull() | one_of("policy_decision", "policy_decision")}),
    "scan_run": ("run_id", {**_present("run_id", "source_id"), **_known(status="scan_status"), **_between("risk_score", 0, 100, nullable=True)}),
    "experiment_log": ("experiment_id", _present("experiment_id")),
    "graph_node": ("node_id", {**_filled("node_id", "label"), "node_type_known": lambda: F.col("node_type").isin(*NODE_TYPES)}),
    "graph_edge": ("edge_id", {**_filled("edge_id", "source_node_id", "target_node_id"), **_between("weight", 0), **_no_blank_in("evidence_span_ids"), "ends_fit_type": edge_spec}),
    "tool_call": ("call_id", {**_filled("action_type", "tool_name"), **_known(risk_level="risk_level"), **_no_blank_in("source_context_ids")}),
    "sandbox_output": ("task_id", {
        **_filled("task_id", "tool_id", "model_id", "policy_mode", "final_report"), **_between("latency", 0), **_no_blank_in("agent_steps"),
        "attack_id_not_blank": lambda: F.col("attack_id").isNull() | not_blank("attack_id"),
        "blocked_were_attempted": lambda: subset("blocked_actions", "attempted_actions"),
    }),
    "evidence_citation": ("evidence_span_id", {**_filled("evidence_span_id"), "line_order": lambda: ordered("start_line", "end_line")}),
    "policy_explanation": ("policy_id", {**_present("policy_id"), **_known(decision="policy_action"), **_between("confidence", 0.0, 1.0)}),
}


def finding_violations(findings: DataFrame) -> DataFrame:
    return violations(findings, "finding_id", {n: c() for n, c in FINDING_CHECKS.items()})


def record_violations(records: DataFrame, kind: str) -> DataFrame:
    """(kind, record_key, failed_check): every check of its kind that a record fails. Narrow; records are not dropped."""
    key, checks = RECORD_CHECKS[kind]
    return violations(records, key, {n: c() for n, c in checks.items()}).select(F.lit(kind).alias("kind"), "record_key", "failed_check")


# Errors and logs.


def _default(category: Column, index: int, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, values in ERROR_DEFAULTS.items():
        out = F.when(category == name, F.lit(values[index])).otherwise(out)
    return out


def normalize_errors(errors: DataFrame) -> DataFrame:
    """Fill category defaults. ``errors(request_id, category, error_code, status_code, ...)``.

    A 429 status is a rate limit, an unknown category a report error with a generic code.
    """
    given = F.col("category")
    known = given.isin(*ERROR_DEFAULTS)
    category = (
        F.when(known, given)
        .when(F.col("status_code") == 429, "rate_limit_error")
        .otherwise("report_error")
    )
    named = errors.withColumn("category", category)
    has = lambda n: n in errors.columns
    c = F.col("category")

    def filled(name: str, index: int, kind: str) -> Column:
        default = _default(c, index, kind)
        return (F.coalesce(F.col(name), default) if has(name) else default).alias(name)

    message = filled("user_message", 3, "string")
    keep = [n for n in errors.columns if n not in ("category", "error_code", "status_code", "recoverable", "retryable", "user_message")]
    return named.select(
        *keep, "category", F.coalesce("error_code", F.lit("unhandled_exception")).alias("error_code"),
        filled("status_code", 0, "int"), filled("recoverable", 1, "boolean"), filled("retryable", 2, "boolean"), message,
    )


def public_errors(records: DataFrame) -> DataFrame:
    """Only what may leave the service; stack traces and contexts are not selected."""
    renamed = records.withColumnRenamed("user_message", "message")
    return renamed.select(*[n for n in PUBLIC_ERROR_FIELDS if n in renamed.columns])


def public_projection(records: DataFrame) -> DataFrame:
    """Drop raw text, query text, vectors and internals from any record."""
    return records.drop(*PRIVATE_FIELDS)


LOG_FIELDS = (
    "timestamp", "service", "request_id", "trace_id", "config_hash", "run_id", "source_id", "tool_id", "event_type",
    "status", "latency_ms", "error_code", "metadata",
)


def log_rows(events: DataFrame) -> DataFrame:
    """Typed log rows: latency to 3 digits, ISO timestamp in milliseconds, absent ids null."""
    given = set(events.columns)

    def value(name: str) -> Column:
        if name == "timestamp":
            return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(name)
        if name == "latency_ms":
            return F.round("latency_ms", 3).alias(name)
        if name not in given:
            return F.lit(None).cast("map<string,string>" if name == "metadata" else "string").alias(name)
        return F.col(name).alias(name) if name == "metadata" else F.col(name).cast("string").alias(name)

    return events.select(*[value(n) for n in LOG_FIELDS])


# Digests, facets, inventory.


SPAN_FIELDS = ("span_id", "artifact_id", "start_line", "end_line", "preview", "span_type", "content_hash")


def span_snapshot_hashes(spans: DataFrame) -> DataFrame:
    return spans.select("span_id", canonical_hash(*SPAN_FIELDS).alias("snapshot_hash"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: order-free digest and row count of a table."""
    rows = df.select(canonical_hash(*df.columns).alias("row_hash"))
    return rows.agg(F.count("*").alias("row_count"), multiset_digest(F.col("row_hash")).alias("digest"))


def scan_manifest(results: DataFrame, dataset_digest: DataFrame, experiment_name: str, dataset_path: str, random_seed: int, names: Sequence[str]) -> DataFrame:
    """Manifest row of an experiment: dataset digest, result count, seed and artifact names."""
    if random_seed < 0:
        raise ValueError("random_seed must not be negative.")
    counted = results.agg(F.count("*").alias("result_count"))
    return counted.select(
        F.lit(experiment_name).alias("experiment_name"), F.lit(dataset_path).alias("dataset_path"),
        dataset_digest.select("digest").scalar().alias("dataset_hash"), "result_count",
        F.lit(random_seed).alias("random_seed"), F.array(*[F.lit(n) for n in names]).alias("artifact_filenames"),
    )


SEARCH_FIELDS = ("evidence_id", "finding_type", "artifact_type", "file_path", "preview", "context_text")


def search_evidence(
    evidence: DataFrame, query: str = "", source_trust: str | None = None, finding_type: str | None = None, artifact_type: str | None = None
) -> DataFrame:
    """Substring over the joined fields and up to three exact facets."""
    wanted = query.strip().lower()
    keep = F.lit(True)
    for name, value in (("source_trust", source_trust), ("finding_type", finding_type), ("artifact_type", artifact_type)):
        if value is not None:
            keep = keep & (F.col(name) == value)
    if wanted:
        joined = F.concat_ws(" ", *[F.coalesce(n, F.lit("")) for n in SEARCH_FIELDS])
        keep = keep & F.lower(joined).contains(wanted)
    return evidence.where(keep)


def facet_values(evidence: DataFrame, *names: str) -> DataFrame:
    """Distinct values and counts of each facet in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])
    return evidence.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def latency_bucket(latency: Column) -> Column:
    bucket = F.lit("1000+")
    for limit, name in reversed(LATENCY_BUCKETS):
        bucket = F.when(latency < limit, name).otherwise(bucket)
    return bucket


def inventory_totals(tools: DataFrame) -> DataFrame:
    """Tool count, findings and rounded mean risk of an inventory(finding_count, risk_score)."""
    return tools.agg(
        F.count("*").alias("tool_count"), F.coalesce(F.sum("finding_count"), F.lit(0)).alias("finding_total"),
        F.coalesce(F.floor(F.avg("risk_score") + 0.5), F.lit(0)).alias("mean_risk"),
    )
