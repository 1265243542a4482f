"""Evidence-grounded reports as tables: header, findings, recommendations, rendered lines.

A run may hold a third of all findings, so no report is ever assembled in one cell. Order is
carried by sort columns and only applied, range-partitioned, when lines are written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions.ids import multiset_digest, stable_id
from docvet.functions.text import markdown_number

ORDER = ("path", "artifact_id", "detector_rank", "start_line", "rule_rank")


def _with_order(findings: DataFrame) -> DataFrame:
    """Reading order inside a run: file, injection rules first, then line, then rule."""
    return findings.withColumn("detector_rank", F.when(F.col("detector") == "prompt_injection", 0).otherwise(1))


def report_findings(findings: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Findings with their citation: the path they carry or, with ``artifacts``, the path there; without any, the artifact id."""
    known = findings
    if artifacts is not None:
        known = findings.drop("path").join(artifacts.select("artifact_id", "path"), "artifact_id", "left")
    return _with_order(known.withColumn("path", F.coalesce("path", "artifact_id"))).select(
        "run_id", "finding_id", F.col("category").alias("finding_type"), "severity", "confidence", "rule_id",
        F.col("span_id").alias("evidence_id"), "artifact_id", F.col("path").alias("file_path"), "path",
        "start_line", "end_line", "preview", "content_hash",
        F.col("rationale").alias("inferred_risk"), "recommendation", "detector_rank", "rule_rank",
    )


def unique_recommendations(report: DataFrame) -> DataFrame:
    """Each recommendation of a run once, ranked by where it is first given."""
    first = report.groupBy("run_id", "recommendation").agg(F.min(F.struct(*ORDER)).alias("first_at"))
    # One row per (run, rule text): the group is bounded by the rule set, not by the data.
    ranked = first.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("first_at", "recommendation"))).alias("items")
    )
    return ranked.select("run_id", F.posexplode("items").alias("pos", "item")).select(
        "run_id", (F.col("pos") + 1).alias("pos"), F.col("item.recommendation").alias("recommendation")
    )


def summary_text(assessment: DataFrame) -> Column:
    return F.concat(
        F.lit("Detected "), F.col("finding_count").cast("string"),
        F.lit(" evidence-backed finding(s). Risk is "), F.col("risk_level"),
        F.lit(" with policy decision "), F.col("policy_decision"), F.lit("."),
    )


def report_headers(assessment: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs(run_id, source_id, source_path)`` joined with the assessment of each run."""
    return runs.join(assessment, "run_id").select(
        F.concat(F.lit("report_"), "run_id").alias("report_id"), "run_id", "source_id", "source_path",
        "risk_score", "risk_level", "policy_decision", "finding_count", summary_text(assessment).alias("summary"),
    )


def core_findings(findings: DataFrame, assessment: DataFrame) -> DataFrame:
    """Persisted finding records: the decision of the run is copied onto each finding."""
    return findings.join(assessment.select("run_id", "policy_decision"), "run_id").select(
        "finding_id", "source_id", F.col("category").alias("finding_type"), "severity", "confidence",
        F.array("span_id").alias("evidence_span_ids"), "rationale", "recommendation", "policy_decision",
    )


def _line(section: int | Column, position: int | Column, line: Column, when: Column | None = None) -> Column:
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    entry = F.struct(number(section).alias("section"), number(position).alias("line_pos"), line.alias("line"))
    return entry if when is None else F.when(when, entry)


def _lines(df: DataFrame, lines: list[Column]) -> DataFrame:
    """All lines of a row at once: one pass over ``df``, whatever sections they belong to."""
    order = [F.col(c) if c in df.columns else F.lit(None) for c in ORDER]
    types = ("string", "string", "int", "int", "int")
    keys = [o.cast(t).alias(n) for o, t, n in zip(order, types, ORDER)]
    return df.select("run_id", *keys, F.inline(F.array_compact(F.array(*lines)))).select("run_id", "section", *ORDER, "line_pos", "line")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def markdown_lines(headers: DataFrame, report: DataFrame, recommendations: DataFrame, title: str = "Scan Report") -> DataFrame:
    """The Markdown document of every run as ordered line rows."""
    c = F.col
    in_order = lambda section, *lines, when=None: [_line(section, k, x, when) for k, x in enumerate(lines)]
    none = c("finding_count") == 0
    frame = _lines(headers, [
        *in_order(
            0, _text(f"# {title}: ", c("run_id")), _text(""), _text("## Summary"), _text(""),
            _text("- Source: `", c("source_path"), "`"),
            _text("- Risk score: ", c("risk_score").cast("string")),
            _text("- Risk level: ", c("risk_level")),
            _text("- Policy decision: ", c("policy_decision")),
            _text("- Finding count: ", c("finding_count").cast("string")),
            _text(""), _text("## Findings"), _text(""),
        ),
        *in_order(1, _text("No findings detected."), _text(""), when=none),
        *in_order(2, _text("## Recommendations"), _text("")),
        *in_order(3, _text("- No action required."), when=none),
        *in_order(4, _text("")),
    ])
    body = _lines(report, in_order(
        1, _text("### ", c("finding_type")), _text(""),
        _text("- Finding ID: `", c("finding_id"), "`"),
        _text("- Severity: ", c("severity")),
        _text("- Confidence: ", markdown_number(c("confidence"))),
        _text("- Inferred risk: ", c("inferred_risk")),
        _text("- Recommendation: ", c("recommendation")),
        _text("- Evidence:"),
        _text("  - `", c("evidence_id"), "` at `", c("file_path"), ":", c("start_line").cast("string"), "-",
              c("end_line").cast("string"), "`: ", c("preview")),
        _text(""),
    ))
    advice = _lines(recommendations.withColumn("rule_rank", c("pos")), in_order(3, _text("- ", c("recommendation"))))
    return frame.unionByName(body).unionByName(advice)


LINE_ORDER = ("run_id", "section", *ORDER, "line_pos")


def scan_summary(artifacts: DataFrame, skipped: DataFrame, parsed: DataFrame, assessment: DataFrame) -> DataFrame:
    """Per run: scanned and skipped counts, parsed items, and the assessment."""
    scanned = artifacts.groupBy("run_id").agg(F.count("*").alias("scanned_file_count"))
    skips = skipped.groupBy("run_id").agg(F.count("*").alias("skipped_count"))
    items = parsed.groupBy("run_id").agg(
        F.sum("parsed_item_count").alias("parsed_item_count"),
        F.count_if(F.col("parse_error").isNotNull()).alias("parse_error_count"),
    )
    joined = scanned.join(skips, "run_id", "full").join(items, "run_id", "left").join(assessment, "run_id", "left")
    zero = F.lit(0)
    return joined.select(
        "run_id",
        *[F.coalesce(F.col(n), zero).alias(n) for n in (
            "scanned_file_count", "skipped_count", "parsed_item_count", "parse_error_count",
            "finding_count", "risk_score")],
        F.coalesce("risk_level", F.lit("low")).alias("risk_level"),
        F.coalesce("policy_decision", F.lit("allow")).alias("policy_decision"),
    )


def artifact_id(relative_path: Column, content_hash: Column) -> Column:
    return stable_id("artifact", relative_path, content_hash)


def source_id(root_path: Column) -> Column:
    return F.concat(F.lit("source_"), F.substring(F.sha2(root_path, 256), 1, 16))


def run_ids(files: DataFrame) -> DataFrame:
    """Run id of every root path: sha256 over the root and an order-free digest of its (path, hash) rows.

    One rule at every size; rows fold map-side, and no root's files meet in a task.
    """
    row_hash = F.sha2(F.concat("relative_path", F.lit(":"), "content_hash"), 256)
    digests = files.groupBy("root_path").agg(multiset_digest(row_hash).alias("row_digest"))
    digest = F.sha2(F.concat("root_path", F.lit(":"), "row_digest"), 256)
    return digests.select(
        "root_path", F.concat(F.lit("run_"), F.substring(digest, 1, 16)).alias("run_id"), source_id(F.col("root_path")).alias("source_id")
    )
