"""Risk points, assessment per run and the decision that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvet.functions.numbers import half_even_points

# Severity weights, level thresholds and the decision of each level.
SEVERITY_WEIGHTS = {"low": 10, "medium": 35, "high": 65, "critical": 90}
LEVEL_THRESHOLDS = (("critical", 75), ("high", 50), ("medium", 25))
LEVEL_DECISIONS = {"low": "allow", "medium": "warn", "high": "quarantine", "critical": "block"}


def severity_weight(severity: Column) -> Column:
    weight = F.lit(None).cast("int")
    for name, points in SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, points).otherwise(weight)
    return weight


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_WEIGHTS]), severity).cast("int")


def finding_points(severity: Column, confidence: Column) -> Column:
    return half_even_points(severity_weight(severity), F.coalesce(confidence, F.lit(1.0)))


def risk_level(score: Column) -> Column:
    level = F.lit("low")
    for name, threshold in reversed(LEVEL_THRESHOLDS):
        level = F.when(score >= threshold, name).otherwise(level)
    return level


def level_decision(level: Column) -> Column:
    decision = F.lit(None).cast("string")
    for name, action in LEVEL_DECISIONS.items():
        decision = F.when(level == name, action).otherwise(decision)
    return decision


def contributions(findings: DataFrame, *keys: str) -> DataFrame:
    """Points of every finding (child table of the assessment)."""
    confidence = F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return findings.select(
        *keys, "finding_id", "severity", confidence.alias("confidence"),
        finding_points(F.col("severity"), F.col("confidence")).alias("points"),
    )


def assess_risk(runs: DataFrame, findings: DataFrame, key: str = "run_id") -> DataFrame:
    """One assessment per run, with runs that have no findings at 0 / low / allow.

    Points and counts fold map-side, so a run holding most findings costs one row per task.
    """
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITY_WEIGHTS]
    totals = contributions(findings, key).groupBy(key).agg(
        F.sum("points").alias("points"), F.count("*").alias("finding_count"), *counts
    )
    joined = runs.select(key).distinct().join(totals, key, "left")
    score = F.least(F.coalesce(F.col("points"), F.lit(0)), F.lit(100)).cast("int")
    scored = joined.select(
        key, score.alias("risk_score"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["finding_count"] + [f"{s}_count" for s in SEVERITY_WEIGHTS]],
    )
    leveled = scored.withColumn("risk_level", risk_level(F.col("risk_score")))
    return leveled.withColumn("policy_decision", level_decision(F.col("risk_level")))
